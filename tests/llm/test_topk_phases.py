"""The phases of exact top-k: what is resolved, and the bounds that choose it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import topk


def test_only_sufficient_entries_are_resolved():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(4000, 64))
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1)[:, None])
    queries = rows[:100]
    exact = queries @ rows.T
    exact[np.arange(100), np.arange(100)] = -np.inf
    low = np.sort(exact, axis=1)[:, -5]
    part = topk.Queries([(i, (q / 256).tolist()) for i, q in enumerate(queries)]).parts()[64][0]
    q, r = topk.sufficient(part, rows, low)
    assert len(q) < 0.3 * exact.size  # what phase 3 has to resolve
    held = np.zeros(exact.shape, bool)
    held[q, r] = True
    assert held[exact >= low[:, None]].all()  # nothing that could be among the best is missing
    assert (topk.resolve(part.matrix, rows, q, r) == (queries @ rows.T)[q, r]).all()


def test_list_scores_stay_within_their_error():
    rng = np.random.default_rng(3)
    for scale in (1.0, 1e4, 3e9):
        rows, queries = np.floor(scale * rng.normal(size=(300, 50))), np.floor(scale * rng.normal(size=(20, 50)))
        part = topk._Part(np.arange(20), queries)
        for (scores, error), span in zip(topk.list_scores(part, rows), topk._spans(50)):
            assert (np.abs(scores.astype(float) - queries[:, span] @ rows[:, span].T) <= error[:, None]).all()


@pytest.mark.parametrize("n", [3, 700])
def test_several_dimensions_ties_and_repeated_rows(spark, n):
    rng = np.random.default_rng(4)
    rows = [(int(i // 2), rng.integers(-2, 3, 3 + i % 2).astype(float).tolist()) for i in range(n)]
    rows += [(50, [1e300, 1e300, -1e300]), (7, [1e308, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    found = topk.top_k(table, table.where("vec_id % 50 = 0"), query_block=4).collect()
    whole = [(i, [256 * int(x) for x in v]) for i, v in rows]
    asked = {}
    for (i, v), (_, w) in zip(rows, whole):
        if i % 50 == 0 and (i not in asked or v < asked[i][0]):
            asked[i] = (v, w)
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    for i, (_, w) in asked.items():
        scores = sorted((-clip(sum(a * b for a, b in zip(w, v))), j) for j, v in whole if j != i and len(v) == len(w))[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in found if r["query_id"] == i), key=lambda r: r["rank"])] == scores
    assert {r["query_id"] for r in found} <= set(asked)
