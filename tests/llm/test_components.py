"""Components of large and awkward graphs, and joins on hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.common import join_hot, materialize


def simple(edges):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {x: top(x) for x in parent}


def shapes():
    draw = random.Random(1)
    yield "path", [(i, i + 1) for i in range(300)]
    yield "path in any order", list(zip(x := draw.sample(range(1000), 300), x[1:]))
    yield "star", [(5000, i) for i in range(1, 600)]
    yield "two stars, one edge", [(1, i) for i in range(10, 300)] + [(2, i) for i in range(400, 700)] + [(299, 401)]
    yield "many", [(draw.randrange(-500, 500), draw.randrange(-500, 500)) for _ in range(400)]
    yield "saw", [(i, i + 1000) for i in range(200)] + [(i + 1, i + 1000) for i in range(200)]
    yield "none", []


@pytest.mark.parametrize("name,edges", list(shapes()), ids=[n for n, _ in shapes()])
def test_components(spark, name, edges):
    found = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = simple([(a, b) for a, b in edges if a != b])
    assert {r["node"]: r["root"] for r in found} == want and len(found) == len(want)


def test_join_hot(spark):
    left = materialize(spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as k", "id as x"), "left")
    right = materialize(spark.range(0, 3000, 2).selectExpr("id as k", "id * 10 as y").unionByName(spark.sql("select 7L as k, 70L as y")), "right")
    got = {(r["x"], r["k"], r["y"]) for r in join_hot(left, right, "k").collect()}
    assert got == {(x, k, k * 10 if k % 2 == 0 or k == 7 else None) for x in range(3000) for k in [7 if x % 3 == 0 else x]}
    # a hot key that the right side lacks
    assert join_hot(left, right.where("k <> 7").drop("y").withColumn("y", F.lit(1)), "k").where("k = 7 and y is null").count() == 1001
