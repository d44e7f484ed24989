"""Weighted edges, keyed by (src_id, dst_id, kind)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import predicate

KEY = ["src_id", "dst_id", "kind"]
NUMERIC = ("weight", "bonus", "hits", "last_touch")


def _column_names(df: DataFrame) -> list[str]:
    return [*KEY, "weight", "hits", "bonus", "last_touch", *(["metadata"] if "metadata" in df.columns else [])]


def insert(edges: DataFrame, new: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Edges with ``new`` appended. ValueError on a key that exists already, twice among the new, or (with docs) on an unknown end."""
    if not new.join(edges, KEY, "left_semi").isEmpty() or not new.groupBy(*KEY).count().where("count > 1").isEmpty():
        raise ValueError("an edge exists already")
    if docs is not None:
        ends = new.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
        if not ends.join(docs.select("id"), "id", "left_anti").isEmpty():
            raise ValueError("an edge ends at an unknown document")
    return edges.unionByName(new, allowMissingColumns=True)


def upsert(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Values of ``new`` replace those of edges with the same key; nulls keep the old value, or 0 on a new edge."""
    values = [c for c in _column_names(edges) if c not in KEY]
    old, fresh = edges.alias("o"), new.alias("n")
    joined = old.join(fresh, KEY, "full_outer")

    def merged(c: str) -> Column:
        parts = [F.col(f"n.{c}")] if c in new.columns else []
        zero = [F.lit(0)] if c in ("weight", "hits", "bonus") else []
        return F.coalesce(*parts, F.col(f"o.{c}"), *zero).cast(edges.schema[c].dataType).alias(c)

    return joined.select(*KEY, *map(merged, values))


def update(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Deltas (dweight, dbonus, dhits) summed by key and added to the absolute values given (weight, bonus, hits), else to the old ones.

    Many changes of one edge fold into one by partial sums, so concurrent deltas commute; unknown edges are ignored.
    """
    has = changes.columns
    deltas = [F.sum(f"d{c}").alias(f"__d{c}") if f"d{c}" in has else F.sum(F.lit(0)).alias(f"__d{c}") for c in ("weight", "bonus", "hits")]
    absolute = [F.max(c).alias(f"__{c}") for c in ("weight", "bonus", "hits", "last_touch") if c in has]
    folded = changes.groupBy(*KEY).agg(*deltas, *absolute)
    joined = edges.join(folded, KEY, "left")
    for c in ("weight", "bonus", "hits"):
        base = F.coalesce(F.col(f"__{c}"), F.col(c)) if c in has else F.col(c)
        joined = joined.withColumn(c, (base + F.coalesce(F.col(f"__d{c}"), F.lit(0))).cast(edges.schema[c].dataType))
    if "last_touch" in has:
        joined = joined.withColumn("last_touch", F.coalesce("__last_touch", "last_touch"))
    return joined.select(*edges.columns)


def delete(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select(*KEY), KEY, "left_anti")


def get(edges: DataFrame, src: int | None = None, dst: int | None = None, kind: str | None = None, where: dict[str, Any] | None = None, limit: int | None = None) -> DataFrame:
    """Edges by ends, kind and filter; latest touch first, then ends. Numeric columns in the filter are plain predicates."""
    out = edges
    for column, value in (("src_id", src), ("dst_id", dst), ("kind", kind)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if where:
        metadata = F.col("metadata") if "metadata" in edges.columns else F.lit(None).cast("string")
        out = out.where(predicate(where, metadata, {c: F.col(c) for c in NUMERIC}))
    out = out.orderBy(F.desc("last_touch"), "src_id", "dst_id", "kind")
    return out if limit is None else out.limit(limit)


def prune(edges: DataFrame, kind: str | None = None, max_weight: float | None = None, idle_before: float | None = None) -> DataFrame:
    """Edges without those that meet all conditions given; ValueError when none is."""
    doomed: Column | None = None
    for condition in (F.col("kind") == kind if kind is not None else None, F.col("weight") <= max_weight if max_weight is not None else None, F.col("last_touch") <= idle_before if idle_before is not None else None):
        if condition is not None:
            doomed = condition if doomed is None else doomed & condition
    if doomed is None:
        raise ValueError("prune takes a kind, max_weight or idle_before")
    return edges.where(~F.coalesce(doomed, F.lit(False)))
