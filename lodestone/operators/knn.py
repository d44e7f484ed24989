"""Nearest neighbours: exact top-k of one query or of many, and an inverted-file index for approximate search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import K

#: Queries that one pass broadcasts, and queries and rows whose distances are held at a time.
QUERY_BLOCK = 16384
_QUERIES, _ROWS = 512, 4096
#: Recall that an index is tuned to, and the queries that measure it.
RECALL = 0.95
TUNING_QUERIES = 200


def check_dimension(vector: Sequence[float], dim: int | None) -> None:
    if dim is not None and len(vector) != dim:
        raise ValueError(f"a vector of {len(vector)} components; the collection has {dim}")


def search(docs: DataFrame, query: Sequence[float], k: int = K, kind: str = "cosine", where: Column | None = None, digits: int | None = None) -> DataFrame:
    """The k rows nearest to one vector with column ``distance``, ties by id. The predicate is applied before any distance.

    ``digits`` rounds distances before ranking. The plan is a scan and TakeOrderedAndProject: k rows a partition move.
    """
    if k <= 0:
        return docs.limit(0).withColumn("distance", F.lit(0.0))
    rows = docs if where is None else docs.where(where)
    distance = V.distance(kind, F.col("embedding"), V.literal(query))
    distance = F.round(distance, digits) if digits is not None else distance
    return rows.where(F.col("embedding").isNotNull()).withColumn("distance", distance).orderBy("distance", "id").limit(k)


def _distances(kind: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if kind == "hamming":
        a, b = (queries > 0).astype(float), (rows > 0).astype(float)
        return a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * (a @ b.T)
    if kind == "l2":
        return np.maximum(0.0, (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * (queries @ rows.T))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), V.TINY)
    return 1 - unit(queries) @ unit(rows).T


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of an arrow list column, all of one length."""
    sizes = np.diff(np.asarray(lists.offsets))
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in dimension")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(sizes), -1) if len(sizes) else np.zeros((0, 0))


def _offer(held: tuple[np.ndarray, np.ndarray, np.ndarray], q: np.ndarray, d: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least (distance, id) of each query among those held and the new ones, sorted by query."""
    q, d, i = (np.concatenate(x) for x in zip(held, (q, d, i)))
    order = np.lexsort((i, d, q))
    q = q[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
    return q[keep], d[order][keep], i[order][keep]


def search_batch(docs: DataFrame, queries: list[tuple[int, Sequence[float]]], k: int = K, kind: str = "cosine", where: Column | None = None, digits: int = 6) -> DataFrame:
    """(qid, id, distance, rank) for many queries in one pass over the rows: a matrix product per block of queries and rows, of which only
    what may be among the k best is sorted; the k best of each query leave a partition, and ranks are given to what is left. Queries go out in bounded blocks."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "qid long, id long, distance double")
    rows = (docs if where is None else docs.where(where)).where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    for a in range(0, len(queries) if k > 0 else 0, QUERY_BLOCK):
        block = queries[a : a + QUERY_BLOCK]
        names, vectors = np.array([q for q, _ in block]), np.array([v for _, v in block], float)

        def best(batches: Iterator[pa.RecordBatch], names=names, vectors=vectors) -> Iterator[pa.RecordBatch]:
            none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            parts = range(0, len(names), _QUERIES)
            held, reach = {p: none for p in parts}, {p: np.full(min(_QUERIES, len(names) - p), np.inf) for p in parts}
            for batch in batches:
                for s in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(s, _ROWS)
                    own, ids = matrix(part.column(1)), part.column(0).to_numpy(zero_copy_only=False)
                    for p in parts:
                        distance = np.round(_distances(kind, vectors[p : p + _QUERIES], own), digits) + 0.0
                        limit = reach[p]
                        if len(ids) > k and np.isinf(limit).any():
                            limit = np.minimum(limit, np.partition(distance, k - 1, axis=1)[:, k - 1])
                        q, r = np.nonzero(distance <= limit[:, None])
                        held[p] = _offer(held[p], q, distance[q, r], ids[r], k)
                        ends = np.cumsum(np.bincount(held[p][0], minlength=len(limit)))
                        full = np.flatnonzero(np.diff(np.r_[0, ends]) == k)
                        reach[p][full] = held[p][1][ends[full] - 1]
            for p in parts:
                q, d, i = held[p]
                yield pa.RecordBatch.from_arrays([pa.array(names[p + q]), pa.array(i), pa.array(d)], names=["qid", "id", "distance"])

        out = out.unionByName(rows.mapInArrow(best, "qid long, id long, distance double"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


class InvertedFile:
    """Approximate search: rows are dealt to the cells of their nearest centroids; a query looks into ``probes`` cells.

    ``assign`` gives the rows a ``cell`` column (write them sorted by it and probes skip row groups). ``tune`` measures recall and sets ``probes``."""

    def __init__(self, centroids: np.ndarray, kind: str = "cosine", probes: int = 4, recall: float | None = None):
        self.centroids, self.kind, self.probes, self.recall = np.asarray(centroids, float), kind, probes, recall

    @classmethod
    def train(cls, docs: DataFrame, cells: int, kind: str = "cosine", sample_rows: int = 20_000, rounds: int = 8, seed: int = 0) -> "InvertedFile":
        """Lloyd's rounds on a bounded sample, drawn by hash of id."""
        rows = docs.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows)
        points = np.array([r[0] for r in rows.select(F.col("embedding").cast("array<double>")).collect()], float)
        if kind == "cosine" and len(points):
            points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), V.TINY)
        centers = points[: max(1, cells)].copy()
        for _ in range(rounds if len(points) else 0):
            label = _distances("l2", points, centers).argmin(1)
            for c in range(len(centers)):
                if (label == c).any():
                    centers[c] = points[label == c].mean(0)
        return cls(centers, kind)

    def assign(self, docs: DataFrame) -> DataFrame:
        from .cluster import nearest_label

        return docs.withColumn("cell", nearest_label(F.col("embedding") if self.kind != "cosine" else V.l2_normalize(F.col("embedding")), self.centroids))

    def order(self, query: Sequence[float]) -> list[int]:
        """Cells from the nearest on."""
        q = np.asarray(query, float)[None, :]
        if self.kind == "cosine":
            q = q / np.maximum(np.linalg.norm(q), V.TINY)
        return np.argsort(_distances("l2", q, self.centroids)[0], kind="stable").tolist()

    def tune(self, celled: DataFrame, k: int = 10, goal: float = RECALL, sample: int = TUNING_QUERIES, seed: int = 1) -> float:
        """The least probes with which the k best of a bounded sample of rows, against all rows, are found to ``goal``; the recall measured."""
        rows = celled.where(F.col("embedding").isNotNull())
        drawn = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("id", "embedding").collect()
        queries = [(r["id"], list(r["embedding"])) for r in drawn]
        best = search_batch(rows, queries, k, self.kind).join(rows.select("id", "cell"), "id").select("qid", "cell").collect()
        place = {q: {c: i for i, c in enumerate(self.order(v))} for q, v in queries}
        depth = np.sort([place[r["qid"]][r["cell"]] for r in best])
        if len(depth):
            self.probes = int(depth[max(0, int(np.ceil(goal * len(depth))) - 1)]) + 1
            self.recall = float((depth < self.probes).mean())
        return self.recall if self.recall is not None else 1.0

    def search(self, celled: DataFrame, query: Sequence[float], k: int = K, probes: int | None = None, where: Column | None = None) -> DataFrame:
        cells = self.order(query)[: self.probes if probes is None else probes]
        return search(celled.where(F.col("cell").isin(cells)), query, k, self.kind, where)
