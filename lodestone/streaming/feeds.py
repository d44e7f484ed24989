"""Structured Streaming: micro-batch ingest and the change feed as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Progress, VectorCollection
from ..schema import EVENTS


def ingest(rows: DataFrame, collection: VectorCollection, checkpoint: str, on_progress: Callable[[Progress], None] | None = None, available_now: bool = True):
    """A streaming query that appends (text, metadata, embedding, parent_id) rows to a collection, a commit per micro-batch.

    A batch that is run again after a failure finds its number in the manifest and is skipped: each batch is added once.
    """
    done = 0

    def add(batch: DataFrame, number: int) -> None:
        nonlocal done
        store = collection.store
        if store.fact("stream_batch", -1) >= number:
            return
        with store.transaction():
            before = store.fact("last_id", 0)
            n = collection.add_frame(batch)
            store.set_fact("stream_batch", number)
        done += n
        if on_progress:
            on_progress(Progress(number + 1, None, done, n, list(range(before + 1, before + n + 1)) if n <= 100_000 else []))

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def progress_of(docs: DataFrame, batch_size: int, order: str = "id") -> DataFrame:
    """What ingest in batches of ``batch_size`` would report, as a table: batch_num, docs_in_batch, docs_processed. Row numbers come from range partitions."""
    from ..operators.mutate import assign_ids

    numbered = assign_ids(docs.select(F.col(order).alias("__o")), 0, "__o").withColumn("batch_num", F.floor((F.col("id") - 1) / batch_size).cast("long") + 1)
    return numbered.groupBy("batch_num").agg(F.count("*").alias("docs_in_batch"), F.max("id").cast("long").alias("docs_processed"))


def event_stream(spark: SparkSession, path: str, kind: str | None = None, max_files: int = 100) -> DataFrame:
    """The change feed from its folder of Parquet files, as a stream; the checkpoint of its query is the reader's position."""
    out = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).parquet(path)
    return out if kind is None else out.where(F.col("kind") == kind)


def expiries(ttl: DataFrame, now: Column | None = None) -> DataFrame:
    """The due entries of a (streaming) table of expiries."""
    return ttl.where(F.col("expires_at") <= (F.unix_micros(F.current_timestamp()) / 1e6 if now is None else now))
