"""Fusion and re-ranking: reciprocal ranks, maximal marginal relevance, merging of collections."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import CROSS_K, FETCH_K, K, LAMBDA_MULT, RRF_K
from . import keyword, knn


def rrf(dense: DataFrame, sparse: DataFrame, k: int, rrf_k: int = RRF_K, digits: int | None = None) -> DataFrame:
    """(id, score): sum of 1 / (rrf_k + rank) over the two lists of (id, rank), ranks from 1; ties go to the better dense rank, then the sparse."""
    both = dense.select("id", F.col("rank").alias("dense_rank")).join(sparse.select("id", F.col("rank").alias("sparse_rank")), "id", "full_outer")
    part = lambda r: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    score = part("dense_rank") + part("sparse_rank")
    out = both.withColumn("score", F.round(score, digits) if digits is not None else score)
    return out.orderBy(F.desc("score"), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), "id").limit(k)


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Ranks of a list that is k rows long."""
    return rows.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def hybrid(docs: DataFrame, text: str, vector: Sequence[float], k: int = K, kind: str = "cosine", where: Column | None = None, dense_k: int | None = None, sparse_k: int | None = None, rrf_k: int = RRF_K, digits: int | None = None) -> DataFrame:
    """Dense ranks are positions before the predicate, which then drops rows; sparse ranks are positions after it."""
    if not text.strip() or k <= 0:
        return docs.select("id").limit(0).selectExpr("id", "0.0D as score")
    dense = knn.search(docs, vector, dense_k or max(k, 10), kind, digits=digits)
    dense = dense.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))
    dense = dense if where is None else dense.where(where)
    sparse = _ranked(keyword.search(docs, text, sparse_k or max(k, 10), where, digits), "score", "id")
    return rrf(dense, sparse, k, rrf_k, digits).select("id", "score", "dense_rank", "sparse_rank")


def mmr_order(distances: np.ndarray, vectors: np.ndarray, k: int, lam: float) -> list[int]:
    """Greedy picks among candidates in order of distance: relevance 1 - d / 2 against the greatest cosine to a pick."""
    if len(distances) <= k:
        return list(range(len(distances)))
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), V.TINY)
    picks = [0]
    near = unit @ unit[0]
    while len(picks) < k:
        gain = lam * (1 - distances / 2) - (1 - lam) * near
        gain[picks] = -np.inf
        best = int(gain.argmax())
        picks.append(best)
        near = np.maximum(near, unit @ unit[best])
    return picks


def mmr(docs: DataFrame, vector: Sequence[float], k: int = K, fetch_k: int = FETCH_K, lambda_mult: float = LAMBDA_MULT, kind: str = "cosine", where: Column | None = None) -> DataFrame:
    """(id, rank): k diverse rows among the fetch_k nearest; one group of fetch_k rows is re-ranked."""
    if k <= 0:
        return docs.select("id").limit(0).selectExpr("id", "1 as rank")
    near = knn.search(docs, vector, max(fetch_k, k) if fetch_k < k else fetch_k, kind, where).select(F.col("id").cast("long").alias("id"), "distance", V.doubles(F.col("embedding")).alias("v"))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["distance", "id"], kind="stable").reset_index(drop=True)
        picks = mmr_order(group["distance"].to_numpy(), np.stack(group["v"].map(np.asarray).to_list()), k, lambda_mult)
        return pd.DataFrame({"id": group["id"].iloc[picks].to_numpy(), "rank": np.arange(1, len(picks) + 1, dtype=np.int32)})

    return near.groupBy(F.lit(1).alias("g")).applyInPandas(pick, "id long, rank int")


def cross_collection(docs: DataFrame, vector: Sequence[float], collections: Sequence[str] | None = None, k: int = CROSS_K, kind: str = "cosine", where: Column | None = None, normalize_scores: bool = True, digits: int | None = None) -> DataFrame:
    """The k best over all collections (column ``collection``): k of each, scored 1 / (1 + distance) or -distance, in one job."""
    rows = docs if collections is None else docs.where(F.col("collection").isin(list(collections)))
    rows = rows if where is None else rows.where(where)
    distance = V.distance(kind, F.col("embedding"), V.literal(vector))
    distance = F.round(distance, digits) if digits is not None else distance
    own = Window.partitionBy("collection").orderBy("distance", "id")
    best = rows.withColumn("distance", distance).withColumn("__r", F.row_number().over(own)).where(F.col("__r") <= k)
    score = 1.0 / (1.0 + F.col("distance")) if normalize_scores else -F.col("distance")
    return best.withColumn("score", F.round(score, digits) if digits is not None else score).orderBy(F.desc("score"), "collection", "id").limit(k).drop("__r")


def score_transforms(distance: Column, bm25: Column) -> list[Column]:
    """Similarities for adapters: 1 - distance, and 1 / (1 + bm25), null where that divides by zero."""
    return [(1 - distance).alias("dense_similarity"), F.when(bm25 != -1, 1.0 / (1.0 + bm25)).alias("keyword_similarity")]
