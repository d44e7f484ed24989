"""Writes as transforms: append, upsert, cascading delete, metadata merge and counters. Ids are ``id``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

_COUNTER_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def require_finite(rows: DataFrame) -> None:
    """ValueError if any embedding holds NaN or infinity; the whole batch is checked before anything is written."""
    if not rows.where(F.col("embedding").isNotNull() & ~V.is_finite(F.col("embedding"))).isEmpty():
        raise ValueError("an embedding is not finite")


def assign_ids(new: DataFrame, last_id: int, *order: str) -> DataFrame:
    """Ids after ``last_id`` in the order given. Numbers come from counts per hash-free range partition, not from one sorted task."""
    ranged = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    counts = ranged.groupBy("__part").count()
    base = counts.select(F.col("__part").alias("__p"), (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(base), F.col("__part") == F.col("__p")).withColumn("id", F.col("__base") + own + last_id).drop("__part", "__p", "__base")


def latest(new: DataFrame) -> DataFrame:
    """Of equal ids the row with the greatest __seq, where there is such a column."""
    if "__seq" not in new.columns:
        return new
    value = F.struct("__seq", *(c for c in new.columns if c not in ("id", "__seq")))
    return new.groupBy("id").agg(F.max(value).alias("v")).select("id", *(F.col(f"v.{c}").alias(c) for c in new.columns if c not in ("id", "__seq")))


def upsert(docs: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those with the same id; of equal ids in ``new`` the one with the greatest __seq (if there is one) stays."""
    new = latest(new)
    return docs.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents without ``ids``; children of those that go become roots."""
    left = docs.join(ids, "id", "left_anti")
    lost = ids.select(F.col("id").alias("parent_id"), F.lit(True).alias("__lost")).distinct()
    if "parent_id" not in docs.columns:
        return left
    out = left.join(lost, "parent_id", "left").withColumn("parent_id", F.when(F.col("__lost").isNull(), F.col("parent_id")))
    return out.select(*docs.columns)


def delete_edges_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    out = edges
    for end in ("src_id", "dst_id"):
        out = out.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return out


def matching_ids(docs: DataFrame, texts: list[str] | None, where: Column | None) -> DataFrame:
    """Ids by exact text or predicate; ValueError when neither is given."""
    if texts is None and where is None:
        raise ValueError("texts or a filter is needed")
    condition = F.lit(False)
    if texts is not None:
        condition = condition | (F.col("text").isin(texts) if texts else F.lit(False))
    if where is not None:
        condition = condition | where
    return docs.where(condition).select("id")


def merge_json(old: Column, patch: Column) -> Column:
    """Shallow merge of JSON objects, the patch's values winning. Keys come out sorted."""
    entries = lambda c: F.map_entries(F.coalesce(F.from_json(c, "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    patched = F.map_keys(F.coalesce(F.from_json(patch, "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    kept = F.filter(entries(old), lambda e: ~F.array_contains(patched, e["key"]))
    return F.to_json(F.map_from_entries(F.concat(kept, entries(patch))))


def update_metadata(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """patches: (id, patch, __seq): merged in the order of __seq; unknown ids are ignored."""
    fold = F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("__seq", "patch"))), lambda x: x["patch"]), F.lit("{}"), merge_json)
    folded = patches.groupBy("id").agg(fold.alias("__patch"))
    merged = F.when(F.col("__patch").isNotNull(), merge_json(F.col("metadata"), F.col("__patch"))).otherwise(F.col("metadata"))
    return docs.join(folded, "id", "left").withColumn("metadata", merged).select(*docs.columns)


def counter_value(metadata: Column, key: str) -> Column:
    """The counter as a double, null where it is missing or no number."""
    if not _COUNTER_KEY.fullmatch(key):
        raise ValueError(f"not a counter: {key!r}")
    value = F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"), F.try_variant_get(value, "$", "double"))


def increment(docs: DataFrame, deltas: DataFrame, key: str) -> DataFrame:
    """deltas: (id, delta). Summed by id, so any number of concurrent increments adds up; the result is a real number."""
    sums = deltas.groupBy("id").agg(F.sum(F.col("delta").cast("double")).alias("__delta"))
    value = F.coalesce(counter_value(F.col("metadata"), key), F.lit(0.0)) + F.col("__delta")
    patched = merge_json(F.coalesce("metadata", F.lit("{}")), F.to_json(F.create_map(F.lit(key), value)))
    return docs.join(sums, "id", "left").withColumn("metadata", F.when(F.col("__delta").isNotNull(), patched).otherwise(F.col("metadata"))).select(*docs.columns)
