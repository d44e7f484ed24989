"""Exact top-k inner products by a three-phase uniform threshold.

A vector's score is the sum of its scores in ``LISTS`` local lists, blocks of its components. For a pass of queries (``QUERY_BLOCK`` and
``QUERY_BYTES`` at most, so that what is broadcast is bounded):

1. every task gathers, for each query and list, the entries with the k best list scores, and resolves them in full; the k-th best
   full score over all tasks is a lower bound of the query's final k-th score;
2. the bounds are broadcast; a vector at or above its query's bound reaches the uniform cutoff, bound / LISTS, in at least one list, so the
   entries at or above the cutoff in some list are sufficient;
3. only their scores are resolved, exactly; a task passes on its k best at most.

Components are floor(256 * x), so full scores are integers: resolved in float64 while those are exact there, in Python's integers
otherwise (scores beyond a long are clipped to its range). List scores only choose entries: they are float32 products, and the cutoff is
lowered by a bound of their rounding error. Where components are too large for that bound, every entry is sufficient.

Defined cases: null vectors and those with null or non-finite components take no part, nor do rows without id; vectors of
another length than the query's are no candidates of it; a query with fewer candidates than k gets them all; ties go to
the smaller id; repeated rows are candidates each; a repeated query id counts once, with its smallest vector; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 5
LISTS = 4
SCALE = 256
#: Queries of one pass over the vectors, and bytes of their components: the bound of what is broadcast.
QUERY_BLOCK = 32768
QUERY_BYTES = 32 << 20
#: Queries and rows whose list scores are held at a time.
_QUERIES, _ROWS = 512, 2048
#: Products of queries and components that a resolving step holds.
_RESOLVED = 1 << 20
_EXACT = float(1 << 52)
#: Components up to here are finite and their products too in float32.
_NARROW = float(1 << 40)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part, v the integer components as doubles."""
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return raw.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", finite)).select("id", F.col("x").alias("v"))


def _quantize(values: np.ndarray) -> np.ndarray:
    """floor(256 * x); integers of Python where a double can't hold them."""
    if not values.size or np.abs(values).max() < 1e290:
        return np.floor(SCALE * values)
    return np.array([int(x) * SCALE if abs(x) > 2.0**53 else int(np.floor(SCALE * x)) for x in values.ravel().tolist()], object).reshape(values.shape)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of rows of equal dimension, a bounded number at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            part = batch.slice(k, _ROWS)
            ids, lists = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                yield ids[own], _quantize(flat[starts[own][:, None] + np.arange(d)])


def _spans(d: int) -> list[slice]:
    cuts = np.linspace(0, d, LISTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]


def _largest(m: np.ndarray) -> float:
    try:
        return float(abs(m).max()) if m.size else 0.0
    except OverflowError:  # an integer beyond doubles
        return float("inf")


def resolve(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact full scores of the pairs (q[i], r[i])."""
    d = queries.shape[1]
    exact = _largest(queries) * _largest(rows) * max(1, d) < _EXACT
    step = max(1, _RESOLVED // max(1, d))
    if exact:
        return np.concatenate([np.einsum("ij,ij->i", queries[q[a : a + step]], rows[r[a : a + step]]) for a in range(0, len(q), step)] or [np.zeros(0)])
    whole = lambda m: [[int(x) for x in v] for v in m.tolist()]
    left, right = whole(queries), whole(rows)
    return np.array([sum(x * y for x, y in zip(left[i], right[j])) for i, j in zip(q.tolist(), r.tolist())], object)


class Best:
    """For each query the k best (score, id) so far; ties go to the smaller id. ``score`` may be a list score or a full one."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def floors(self) -> np.ndarray:
        """The k-th best score of each query, -inf where there are fewer."""
        out = np.full(self.n, -np.inf)
        ends = np.cumsum(np.bincount(self.q, minlength=self.n))
        full = np.flatnonzero(np.diff(np.r_[0, ends]) == self.k)
        out[full] = self.score[ends[full] - 1].astype(float)
        return out

    def offer(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        if score.dtype == object and self.score.dtype != object:
            self.score = np.array([int(x) for x in self.score.tolist()], object)
        q, score, ids = np.r_[self.q, q], np.concatenate([self.score, score]), np.r_[self.id, ids]
        if score.dtype == object:
            order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(score[i]), ids[i])), np.int64)
        else:
            order = np.lexsort((ids, -score, q))
        q = q[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = order[place < self.k]
        self.q, self.score, self.id = q[place < self.k], score[keep], ids[keep]

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        low, high = -(1 << 63), (1 << 63) - 1
        whole = [min(high, max(low, int(x))) for x in self.score.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(names[self.q]), pa.array(self.id), pa.array(whole, pa.int64())], names=["query_id", "vec_id", "score"])


class _Part:
    """Queries of one dimension: their places in the pass, components, and what bounds the rounding of list scores."""

    def __init__(self, places: np.ndarray, matrix: np.ndarray):
        self.places, self.matrix = places, matrix
        self.narrow = _largest(matrix) < _NARROW
        spans = _spans(matrix.shape[1])
        self.lists = [np.ascontiguousarray(matrix[:, s], np.float32) for s in spans] if self.narrow else []
        self.norms = [np.linalg.norm(m.astype(float), axis=1) for m in self.lists]


class Queries:
    """The queries of a pass: ids, and for each dimension their places and vectors."""

    def __init__(self, rows: list[tuple[int, list[float]]]):
        self.names = np.array([q for q, _ in rows], np.int64)
        sizes = np.array([len(v) for _, v in rows], np.int64)
        self.by = {d: (own := np.flatnonzero(sizes == d), np.array([rows[i][1] for i in own.tolist()], float).reshape(-1, d)) for d in np.unique(sizes).tolist()}

    def parts(self) -> dict[int, list[_Part]]:
        """dimension -> parts of _QUERIES queries."""
        return {d: [_Part(own[a : a + _QUERIES], _quantize(m[a : a + _QUERIES])) for a in range(0, len(own), _QUERIES)] for d, (own, m) in self.by.items()}


def list_scores(part: _Part, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per list the float32 scores, (queries, rows), and for each query a bound of their error: each component is rounded once, and a sum of n products
    by n units more."""
    for own, norms, span in zip(part.lists, part.norms, _spans(rows.shape[1])):
        block = rows[:, span]
        reach = float(np.linalg.norm(block, axis=1).max(initial=0))
        yield own @ block.astype(np.float32).T, norms * (reach * (own.shape[1] + 4) * 2.0**-23)


def _gather(queries: Queries, k: int) -> Callable:
    """Phase 1: for each query the k best full scores among the entries with the best scores of each local list."""
    names = queries.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a vector's place in the task tells it from others of its id
        parts, seen = queries.parts(), 0
        tops = {d: [[Best(len(p.places), k) for _ in range(LISTS)] for p in ps] for d, ps in parts.items()}
        found = Best(len(names), k)
        for ids, rows in _blocks(batches):
            d = rows.shape[1]
            wide = _largest(rows) >= _NARROW
            for part, lists in zip(parts.get(d, []), tops.get(d, [])):
                if wide or not part.narrow:
                    continue  # no list scores; the bound may be lower for it, which is safe
                chosen = []
                for top, (scores, _) in zip(lists, list_scores(part, rows)):
                    if len(top.q) or len(ids) <= k + 1:
                        q, r = np.nonzero(scores > top.floors().astype(np.float32)[:, None])
                    else:  # one more than k: the query's own row may be among them
                        r = np.argpartition(scores, len(ids) - k - 1, axis=1)[:, -k - 1 :].ravel()
                        q = np.repeat(np.arange(len(part.places)), k + 1)
                    own = ids[r] != names[part.places[q]]
                    q, r = q[own], r[own]
                    top.offer(q, scores[q, r].astype(float), seen + r)
                    chosen.append(q * len(ids) + r)
                pairs = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
                q, r = pairs // len(ids), pairs % len(ids)
                found.offer(part.places[q], resolve(part.matrix, rows, q, r), ids[r])
            seen += len(ids)
        yield found.batch(names)

    return run


def sufficient(part: _Part, rows: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: pairs (q, r) at or above the uniform cutoff low / LISTS in some list. ``low``: a bound for each query, -inf where there is none."""
    if not part.narrow or _largest(rows) >= _NARROW:
        return tuple(x.ravel() for x in np.indices((len(part.places), len(rows))))
    held = np.zeros((len(part.places), len(rows)), bool)
    for scores, error in list_scores(part, rows):
        cut = low / LISTS - error
        held |= scores >= np.nextafter(cut.astype(np.float32), np.float32(-np.inf))[:, None]
    return np.nonzero(held)


def _resolve(queries: Queries, bounds: dict[int, int], k: int) -> Callable:
    """Phases 2 and 3: the sufficient entries, resolved; the k best of each query."""
    names, least = queries.names, -(1 << 63)
    lows = np.array([float(bounds[q]) if bounds.get(q, least) > least else -np.inf for q in names.tolist()])
    lows = np.where(np.abs(lows) >= _EXACT, np.nextafter(lows, -np.inf), lows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, found = queries.parts(), Best(len(names), k)
        for ids, rows in _blocks(batches):
            for part in parts.get(rows.shape[1], []):
                low = lows[part.places]
                q, r = sufficient(part, rows, low)
                own = ids[r] != names[part.places[q]]
                q, r = q[own], r[own]
                scores = resolve(part.matrix, rows, q, r)
                high = scores >= low[q] if scores.dtype != object else np.array([x >= y for x, y in zip(scores.tolist(), low[q].tolist())], bool)
                found.offer(part.places[q[high]], scores[high], ids[r[high]])
        yield found.batch(names)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each row of ``queries`` but those of its own id."""
    rows = usable(vectors, id_col, vector_col)
    asked = materialize(usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, widest = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    query_block = max(1, min(query_block, QUERY_BYTES // (8 * max(1, widest or 0))))
    passes = -(-n // query_block)
    schema = "query_id long, vec_id long, score long"
    spark = vectors.sparkSession
    out = spark.createDataFrame([], schema)
    for b in range(passes):
        # ids are dealt by hash; a pass that comes out too large is cut
        block = [(r["id"], r["v"]) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == b).toLocalIterator()]
        for a in range(0, len(block), query_block):
            part = Queries(block[a : a + query_block])
            gathered = rows.mapInArrow(_gather(part, k), schema)
            bounds = {r["query_id"]: r["score"] for r in _ranked(gathered, k).where(F.col("rank") == k).select("query_id", "score").collect()}
            out = out.unionByName(materialize(_ranked(rows.mapInArrow(_resolve(part, bounds, k), schema), k).select("query_id", "vec_id", "score"), "top"))
    return _ranked(out, k).select("query_id", "rank", "vec_id", "score")
