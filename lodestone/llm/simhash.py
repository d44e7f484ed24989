"""SimHash near-duplicates by anchor-point covering.

The 64-bit fingerprint is cut into two halves of 32 bits. Two fingerprints that differ in at most 3 bits differ in at
most 1 bit of some half. The anchors of a half are the code words of the perfect Hamming(31, 26) code over its low 31
bits: every half lies within the covering radius 1 of one anchor. A fingerprint is replicated to every anchor within
radius + 1 = 2 bits (16 at most), so a linked pair always meets at the anchor that is home to one of the two, and
fingerprints are compared per anchor only. (The two bits outside the codes are compared, not covered.)

Only distinct fingerprints are compared: groups of equal fingerprints are folded first. A comparison leaves a spanning
forest of each anchor's links, never all its pairs; an anchor with more than ``block`` fingerprints is cut into blocks,
and pairs of blocks are compared apart, in different tasks. Components of the forests come from contraction to minimum labels
over tables in the shared folder.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; repeated rows keep one
result row each; rows without doc_id get the smallest doc_id of their component, null if it has none; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, join_hot, materialize, slices
from .xxh64 import xxh64

SHINGLE = 3
THRESHOLD = 3
#: Fingerprints of one anchor that one task compares with one another.
BLOCK = 8192
#: Groups up to this size are compared pair by pair, all groups of a batch at once.
_SMALL = 12
_BLOCK_BYTES = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Each byte's bits as eight counters of a byte.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def block_fingerprints(texts: list[str | None]) -> np.ndarray:
    """SimHash of every text of a block; all numpy but for the concatenation."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = _LOWER[np.frombuffer(b" ".join(encoded) + b" ", np.uint8)]
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    text_end = np.cumsum(sizes + 1)
    blank = _BLANK[raw]
    first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    last = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    doc = np.searchsorted(text_end, first, "right")
    counts = np.bincount(doc, minlength=len(texts))
    # words, one space after each: a shingle is then one substring
    lengths = last - first
    packed_end = np.cumsum(lengths + 1)
    packed_start = packed_end - lengths - 1
    keep = ~blank
    keep[last] = True  # the blank after a word; the buffer ends in one
    packed = raw[keep]
    packed[packed_end - 1] = 32
    word_end = np.cumsum(counts)
    shingles = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), shingles)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + (word_end - counts)[owner]
    until = np.minimum(at + SHINGLE, word_end[owner]) - 1
    start = packed_start[at]
    hashes = xxh64(packed.tobytes(), start, packed_end[until] - 1 - start)
    # bits are counted in byte-wide counters over runs of at most 255 shingles, then over the runs of a text
    cut = np.unique(np.r_[np.cumsum(shingles)[:-1], np.arange(0, len(owner), 255), 0]) if len(owner) else np.zeros(0, np.int64)
    cut = cut[cut < len(owner)]
    totals = np.zeros((len(texts), 64), np.int64)
    if len(owner):
        octets = hashes.view(np.uint8).reshape(-1, 8)
        by = np.stack([np.add.reduceat(_SPREAD[octets[:, k]], cut) for k in range(8)], axis=1)
        part = by.view(np.uint8).reshape(len(cut), 64).astype(np.int64)
        of = owner[cut]
        lead = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        totals[of[lead]] = np.add.reduceat(part, lead)
    bits = 2 * totals > shingles[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, fp: the SimHash as a signed long of the same 64 bits; with a key (a long) that as well."""
    further = [] if key is None else ["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), _BLOCK_BYTES):
                fp = block_fingerprints(batch.column(1).slice(a, b - a).to_pylist())
                more = [batch.column(2 + k).slice(a, b - a) for k in range(len(further))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64)), *more], names=["doc_id", "fp", *further])

    own = [] if key is None else [key.cast("long").alias("key")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *own).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *further]))


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Hamming(31, 26) syndrome of the low 31 bits: the xor of the numbers 1..31 of the set bits."""
    x = x.astype(np.uint64)
    out = np.zeros(len(x), np.uint64)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        out |= (np.bitwise_count(x & np.uint64(mask)) & 1).astype(np.uint64) << np.uint64(k)
    return out


def covering_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: for every 31-bit value all code words within 2 bits."""
    half = np.asarray(half, np.uint64) & np.uint64((1 << 31) - 1)
    syndrome = _syndromes(half)
    flips = np.zeros((32, 16), np.uint64)  # per syndrome s: flip bit s, or bits i and j with i xor j = s
    for s in range(1, 32):
        flips[s] = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
    exact = syndrome == 0  # a code word: the next one is 3 bits away
    rows = np.r_[np.flatnonzero(exact), np.repeat(np.flatnonzero(~exact), 16)]
    anchors = np.r_[half[exact], (half[~exact][:, None] ^ flips[syndrome[~exact].astype(np.int64)]).ravel()]
    return rows, anchors


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(fp), 65536):
            part = fp[k : k + 65536]
            for half in (0, 1):
                rows, anchors = covering_anchors(part >> np.uint64(32 * half))
                keys = (anchors << np.uint64(1)) | np.uint64(half)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part[rows].view(np.int64))], names=["anchor", "fp"])


def forest(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, breadth first; len(fps) - 1 edges at most."""
    left = np.sort(fps.view(np.uint64))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= threshold
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                left = left[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]).view(np.int64), np.concatenate(b or [none]).view(np.int64)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["a", "b", "anchor", "part", "parts"])


def _compare_groups(block: int):
    """Over rows sorted by anchor: links, as (a, b); rows of larger anchors as (a, null, anchor, part, parts)."""

    def compare(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[cut, len(keys)])
        size = np.repeat(sizes, sizes)
        place = np.arange(len(keys)) - np.repeat(cut, sizes)
        unsigned = fps.view(np.uint64)
        small = (size > 1) & (size <= _SMALL)
        for d in range(1, _SMALL):
            i = np.flatnonzero(small & (place + d < size))
            if not len(i):
                break
            i = i[np.bitwise_count(unsigned[i] ^ unsigned[i + d]) <= THRESHOLD]
            if len(i):
                yield _edges(fps[i], fps[i + d])
        for g in np.flatnonzero(sizes > _SMALL).tolist():
            own = fps[cut[g] : cut[g] + sizes[g]]
            if len(own) <= block:
                a, b = forest(own)
                if len(a):
                    yield _edges(a, b)
            else:
                parts = -(-len(own) // block)
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(n, pa.int64()), pa.array(np.full(n, keys[cut[g]])), pa.array(np.arange(n) // block), pa.array(np.full(n, parts))], names=["a", "b", "anchor", "part", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:  # the last anchor of a batch waits for the next batch
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[fps, batch.column(1).to_numpy(zero_copy_only=False)]
            if len(keys) and keys[0] != keys[-1]:
                k = int(np.searchsorted(keys, keys[-1]))
                yield from compare(keys[:k], fps[:k])
                keys, fps = keys[k:], fps[k:]
        yield from compare(keys, fps)

    return run


def _compare_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (anchor, i, j), where each such group holds two blocks of an anchor at most."""
    held: list[np.ndarray] = []
    now = None
    for batch in batches:
        table = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        cut = np.flatnonzero(np.r_[True, (np.diff(table[0]) != 0) | (np.diff(table[1]) != 0) | (np.diff(table[2]) != 0)]) if batch.num_rows else []
        for s, e in zip(cut, [*cut[1:], batch.num_rows]):
            key = tuple(int(table[k][s]) for k in range(3))
            if key != now and held:
                a, b = forest(np.concatenate(held))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                held = []
            now = key
            held.append(table[3][s:e])
    if held:
        a, b = forest(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links whose closure is that of all pairs of fingerprints within the threshold. ``distinct``: column fp."""
    replicas = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    grouped = replicas.repartition("anchor").sortWithinPartitions("anchor", "fp")
    found = materialize(grouped.mapInArrow(_compare_groups(block), "a long, b long, anchor long, part long, parts long"), "links")
    hot = found.where("anchor is not null")
    pairs = hot.selectExpr("anchor", "a", "explode(transform(sequence(0L, parts - 1), x -> struct(least(x, part) as i, greatest(x, part) as j))) as p")
    rest = pairs.selectExpr("anchor", "p.i as i", "p.j as j", "a").repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(_compare_parts, "a long, b long")
    return found.where("anchor is null").select("a", "b").unionByName(rest).distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node of each node's component, for every node that has an edge.

    Each round labels every node with the smallest one around it, jumps to the label's label until that is a node without a smaller
    neighbour, and contracts the edges to those between labels; what has no edge left is settled and drops out. At least half of a
    component's nodes go in a round, so rounds and jumps grow with the logarithm of the largest component and the tables shrink. The
    rounds' labels are then put one after the other.
    Joins on a hub of many edges, or on the label of many nodes, go by ``join_hot``. Raises when max_rounds don't settle it.
    """
    left = materialize(edges.selectExpr("least(a, b) as a", "greatest(a, b) as b").where("a < b").distinct(), "edges")
    labels = []
    while not left.isEmpty():
        if len(labels) >= max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        around = left.selectExpr("a as node", "a as root").unionByName(left.selectExpr("b as node", "a as root"))
        label = materialize(around.groupBy("node").agg(F.min("root").alias("root")), "labels")
        moved = True
        while moved:
            jump = label.selectExpr("node as root", "root as to")
            jumped = materialize(join_hot(label, jump, "root").selectExpr("node", "to as root", "to <> root as moved"), "labels")
            moved = not jumped.where("moved").isEmpty()
            discard(label)
            label = jumped.drop("moved")
        labels.append(label)
        ends = join_hot(left.withColumnRenamed("a", "node"), label, "node").selectExpr("root as a", "b as node")
        ends = join_hot(ends, label, "node").selectExpr("a", "root as b").where("a <> b")
        narrow = materialize(ends.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "edges")
        discard(left)
        left = narrow
    if not labels:
        return left.selectExpr("a as node", "b as root")
    discard(left)
    found = labels.pop()
    while labels:
        # a label without edges in the later rounds stays
        earlier = labels.pop()
        later = found.selectExpr("node as root", "root as to")
        joined = materialize(join_hot(earlier, later, "root").selectExpr("node", "coalesce(to, root) as root"), "labels")
        discard(earlier, found)
        found = joined
    return found


def _rooted(marked: DataFrame, block: int) -> DataFrame:
    """fp, least_id, root for every distinct fingerprint of marked."""
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(links(distinct, block))
    return materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").selectExpr("fp", "least_id", "coalesce(root, fp) as root"), "roots")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    marked = materialize(fingerprints(docs), "fingerprints")
    by_root = _rooted(marked, block)
    least = by_root.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = materialize(join_hot(by_root, least, "root").select("fp", "component_id"), "components")
    return join_hot(marked, of, "fp").selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) as fingerprint", "component_id")


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns, nulls included. Rows with the same doc_id and key are taken to be equal."""
    return F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each component, with all columns: that with the smallest doc_id (one without only if none has any), of several the one
    with the smallest fingerprint and key. Which row stays never depends on rows of other components, even if they share its doc_id.

    Only ids, fingerprints and keys are shuffled to decide; the documents then meet the keys of the rows that go, which are broadcast up to
    ``BROADCAST_ROWS`` of them and joined beyond. Columns named __own, __id or __key are an error."""
    if {"__own", "__id", "__key"} & set(docs.columns):
        raise ValueError("columns __own, __id and __key are the operator's own")
    marked = materialize(fingerprints(docs, row_key(docs)), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "fp", "key")
    least = marked.groupBy("fp").agg(F.min(rank).alias("first"))
    of = materialize(_rooted(marked, block).select("fp", "root").join(least, "fp"), "firsts")
    best = materialize(of.groupBy("root").agg(F.min("first").alias("best")), "best")
    several = join_hot(marked, materialize(join_hot(of, best, "root").select("fp", "best"), "best"), "fp")
    gone = several.where(rank != F.col("best")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    repeated = marked.groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    return _without(docs, materialize(gone, "gone"), materialize(repeated, "repeated"))


def _without(docs: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    keyed = docs.withColumn("__own", row_key(docs))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key"))
    few = lambda keys: F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys
    kept = keyed.join(few(gone), same, "left_anti")
    if repeated.isEmpty():
        return kept.drop("__own")
    # equal rows are rare: only they are shuffled whole
    repeated = few(repeated)
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__own"])
    return kept.join(repeated, same, "left_anti").unionByName(once).drop("__own")
