"""Hierarchy by parent pointers: (id, parent_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEPTH_CAP


def children(docs: DataFrame, id_: int) -> DataFrame:
    return docs.where(F.col("parent_id") == id_).orderBy("id")


def parent(docs: DataFrame, id_: int) -> DataFrame:
    child = docs.where(F.col("id") == id_).select(F.col("parent_id").alias("__p"))
    return docs.join(F.broadcast(child), docs["id"] == F.col("__p")).drop("__p")


def _walk(docs: DataFrame, seed: str, step: str, max_depth: int | None) -> DataFrame:
    cap = min(DEPTH_CAP, DEPTH_CAP if max_depth is None else max_depth)
    view = f"tree_{id(docs)}"
    docs.select("id", "parent_id").createOrReplaceTempView(view)
    return docs.sparkSession.sql(
        f"""WITH RECURSIVE walk(id, parent_id, depth) MAX RECURSION LEVEL {DEPTH_CAP * 2} AS (
              SELECT id, parent_id, 1 AS depth FROM {view} WHERE {seed} AND {cap} >= 1
              UNION ALL
              SELECT d.id, d.parent_id, w.depth + 1 FROM {view} d JOIN walk w ON {step} WHERE w.depth < {cap})
            SELECT id, depth FROM walk"""
    )


def descendants(docs: DataFrame, id_: int, max_depth: int | None = None) -> DataFrame:
    """(id, depth) below id_, children at depth 1; DEPTH_CAP levels at most, so cycles end."""
    return _walk(docs, f"parent_id = {int(id_)}", "d.parent_id = w.id", max_depth).orderBy("depth", "id")


def ancestors(docs: DataFrame, id_: int, max_depth: int | None = None) -> DataFrame:
    """(id, depth) above id_, the parent at depth 1."""
    view = f"tree_child_{id(docs)}"
    docs.select("id", "parent_id").createOrReplaceTempView(view)
    return _walk(docs, f"id = (SELECT max(parent_id) FROM {view} WHERE id = {int(id_)})", "d.id = w.parent_id", max_depth).orderBy("depth", "id")


def makes_cycle(docs: DataFrame, id_: int, parent_id: int | None) -> bool:
    if parent_id is None:
        return False
    return id_ == parent_id or not descendants(docs, id_).where(F.col("id") == parent_id).isEmpty()


def set_parent(docs: DataFrame, id_: int, parent_id: int | None) -> tuple[DataFrame, bool]:
    """The rows with a new parent, and whether the row exists; ValueError where that would close a cycle."""
    if makes_cycle(docs, id_, parent_id):
        raise ValueError(f"{parent_id} lies below {id_}")
    exists = not docs.where(F.col("id") == id_).isEmpty()
    new: Column = F.lit(parent_id).cast("long")
    return docs.withColumn("parent_id", F.when(F.col("id") == id_, new).otherwise(F.col("parent_id"))), exists
