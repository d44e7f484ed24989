"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a few numbers each that may be broadcast once they are counted.
BROADCAST_ROWS = 1_000_000
#: A key is hot if it has more than one of so many rows; there are fewer hot keys than that.
HOT_SHARE = 200


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local master may fall back to a temporary folder, which is then also set in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may already have gone; the folder's owner cleans up then
        pass


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave and nothing will read again."""
    for df in tables:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


def join_hot(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """``left`` outer join of two stored tables on keys that are never null; ``right`` has at most one row a key. Hot keys of ``left`` (fewer than
    ``HOT_SHARE``, as each has more than one of so many of its rows) meet their rows by broadcast, so none of them lands in one task."""
    n = left.count()
    own = [f"__hot_{k}" for k in keys]
    hot = left.groupBy(*keys).count().where(F.col("count") * HOT_SHARE > n).select(*(F.col(k).alias(h) for k, h in zip(keys, own)), F.lit(True).alias("__hot"))
    same = lambda df: [df[k] == F.col(h) for k, h in zip(keys, own)]
    found = right.join(F.broadcast(hot), same(right), "right").drop(*keys)
    names = [c for c in right.columns if c not in keys]
    marked = left.join(F.broadcast(found), same(left), "left")
    cold = marked.where("__hot is null").drop("__hot", *own, *names).join(right, list(keys), "left")
    return cold.unionByName(marked.where("__hot").drop("__hot", *own))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about ``limit`` bytes each, one row at least."""
    n, start, held = len(column), 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    for i in range(n):
        if held and held + lengths[i] > limit:
            yield start, i
            start, held = i, 0
        held += lengths[i]
    if start < n:
        yield start, n
