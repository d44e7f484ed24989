import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.functions.filters import parse, predicate

METADATA = [{"s": 0.5}, {"s": 5}, {"s": "oops"}, {}, {"s": None}, {"s": True}, {"s": "5"}, {"s": [1, 2]}, {"a": {"b": 3}}, {"s": 5.0, "t": "x"}]


def matching(spark, conditions):
    rows = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(METADATA)], "id long, m string")
    return [r[0] for r in rows.where(predicate(conditions, F.col("m"))).orderBy("id").collect()]


@pytest.mark.parametrize(
    "conditions, expected",
    [
        ({"s": {"$lt": 1}}, [0]),
        ({"s": {"$gt": 0}}, [0, 1, 9]),
        ({"s": 5}, [1, 9]),
        ({"s": "5"}, [6]),
        ({"s": True}, [5]),
        ({"s": {"$ne": 5}}, [0, 2, 3, 4, 5, 6, 7, 8]),
        ({"s": {"$exists": False}}, [3, 4, 8]),
        ({"s": ("between", 1, 5)}, [1, 9]),
        ({"s": ("nin", 5, "oops")}, [0, 3, 4, 5, 6, 7, 8]),
        ({"a.b": 3}, [8]),
        ({"s": 5, "t": "x"}, [9]),
        ({}, list(range(10))),
    ],
)
def test_conditions(spark, conditions, expected):
    assert matching(spark, conditions) == expected


@pytest.mark.parametrize("bad", [{"k": {"$foo": 1}}, {"k": []}, {"k": {"$gt": "1"}}, {"k": {"$between": [2, 1]}}, {"k": ("zz", 1)}, {"k": {"$gt": float("nan")}}, {1: 2}, {"k": list(range(1000))}, {"k": {}}, {"k": ()}])
def test_invalid(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_random_filters_agree_with_sqlite(spark):
    rng = random.Random(3)
    base = sqlite3.connect(":memory:")
    base.execute("create table d(id integer, m text)")
    base.executemany("insert into d values (?, ?)", [(i, json.dumps(m)) for i, m in enumerate(METADATA)])
    sign = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}
    for _ in range(12):
        op, x = rng.choice([*sign, "$eq", "$ne"]), rng.choice([0.5, 1, 5, "5", "oops", True])
        if op in sign and not (isinstance(x, (int, float)) and x is not True):
            continue
        value = "json_extract(m, '$.s')"
        sql = {"$eq": f"{value} = ?", "$ne": f"{value} is null or {value} <> ?"}.get(op) or f"json_type(m, '$.s') in ('integer', 'real') and cast({value} as real) {sign[op]} ?"
        want = [r[0] for r in base.execute(f"select id from d where {sql} order by id", (x,))]
        assert matching(spark, {"s": {op: x}}) == want, (op, x)
