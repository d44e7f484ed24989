"""Change feed, expiry, buffered vectors and maintenance, as transforms of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import REBUILD_FLUSHES, REBUILD_SECONDS, REBUILD_TOMBSTONES, SWEEP_LIMIT

# change feed: (seq, ts, kind, doc_id, payload)


def read_events(events: DataFrame, since: int = 0, kind: str | None = None, limit: int | None = None) -> DataFrame:
    out = events.where(F.col("seq") > since)
    out = out if kind is None else out.where(F.col("kind") == kind)
    out = out.orderBy("seq")
    return out if limit is None else out.limit(limit)


def last_seq(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"))


def prune_events(events: DataFrame, before_seq: int) -> DataFrame:
    return events.where(F.col("seq") >= before_seq)


def append_events(events: DataFrame, new: DataFrame, last: int) -> DataFrame:
    """Number ``new`` (ts, kind, doc_id, payload) after ``last``. Numbers are given per batch of changes, which one commit writes."""
    order = Window.orderBy("ts", F.col("doc_id").asc_nulls_first(), "kind")
    return events.unionByName(new.withColumn("seq", F.row_number().over(order).cast("long") + last))


# expiry: (doc_id, expires_at, on_expire)


def set_ttl(ttl: DataFrame, new: DataFrame) -> DataFrame:
    return ttl.join(new, "doc_id", "left_anti").unionByName(new)


def expired(ttl: DataFrame, now: float, limit: int | None = None) -> DataFrame:
    out = ttl.where(F.col("expires_at") <= now).orderBy("expires_at", "doc_id")
    return out if limit is None else out.limit(limit)


def sweep(docs: DataFrame, ttl: DataFrame, now: float, limit: int = SWEEP_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents left, expiries left, claimed): the oldest ``limit`` due entries are claimed; those on 'delete' take their documents along."""
    claimed = expired(ttl, now, limit)
    gone = claimed.where("on_expire = 'delete'").select(F.col("doc_id").alias("id"))
    return docs.join(gone, "id", "left_anti"), ttl.join(claimed.select("doc_id"), "doc_id", "left_anti"), claimed


# buffered vectors: (doc_id, embedding, source, enqueued_at)


def latest_pending(log: DataFrame) -> DataFrame:
    """The last entry of each document; a fold with map-side combination, no window."""
    value = F.struct("enqueued_at", "source", "embedding")
    return log.groupBy("doc_id").agg(F.max(value).alias("v")).select("doc_id", "v.embedding", "v.source", "v.enqueued_at")


def list_pending(pending: DataFrame, docs: DataFrame, limit: int | None = None) -> DataFrame:
    out = pending.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").orderBy("enqueued_at", "doc_id")
    return out if limit is None else out.limit(limit)


def flush_pending(docs: DataFrame, pending: DataFrame, max_batch: int | None = None) -> DataFrame:
    """Documents with the oldest ``max_batch`` buffered vectors in place."""
    batch = pending if max_batch is None else pending.orderBy("enqueued_at", "doc_id").limit(max_batch)
    new = batch.select(F.col("doc_id").alias("id"), F.col("embedding").alias("__new"))
    return docs.join(new, "id", "left").withColumn("embedding", F.coalesce("__new", "embedding")).select(*docs.columns)


def blend_toward(docs: DataFrame, pending: DataFrame | None, ids: Column, centroid: Column, alpha: float) -> DataFrame:
    """(doc_id, embedding) to buffer: (1 - alpha) v + alpha c, v being the buffered vector where there is one."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    rows = docs.where(ids).select(F.col("id").alias("doc_id"), F.col("embedding").alias("__v"))
    if pending is not None:
        rows = rows.join(pending.select("doc_id", F.col("embedding").alias("__p")), "doc_id", "left").withColumn("__v", F.coalesce("__p", "__v"))
    return rows.select("doc_id", V.blend(F.col("__v"), centroid, alpha).alias("embedding"))


@dataclass(frozen=True)
class RebuildPolicy:
    flushes: int = REBUILD_FLUSHES
    tombstones: int = REBUILD_TOMBSTONES
    seconds: float = REBUILD_SECONDS

    def due(self, flushes: int | Column, tombstones: int | Column, age: float | Column) -> bool | Column:
        """Of numbers, or row by row of columns."""
        return (flushes >= self.flushes) | (tombstones >= self.tombstones) | ((age >= self.seconds) & (flushes >= 1))
