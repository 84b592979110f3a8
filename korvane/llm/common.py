"""Shared plumbing: the folder all executors see, written stages, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: whole texts travel in batches, so few rows bound a worker's memory.
BATCH_ROWS = "512"


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= int(BATCH_ROWS):
        spark.conf.set(key, BATCH_ROWS)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset (local tests), a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="korvane-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, path: str) -> None:
    """At the end of the driver, when nobody reads the table any more."""
    with contextlib.suppress(Exception):  # the JVM may be gone already
        _delete(spark, path)


class Stages:
    """Tables written between the steps of one operator, in the shared folder.

    A written table cuts the lineage: after the loss of an executor the next step rereads it and does not
    run the steps before it again. ``drop`` deletes tables that no later step reads; the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(_forget, spark, self.path)

    def write(self, *parts: DataFrame) -> DataFrame:
        """One table of all parts, written one after another."""
        return self.gather(iter(parts))

    def gather(self, parts: Iterator[DataFrame]) -> DataFrame:
        """One table of all parts; each is written before the next is asked for, so the plan and the driver hold one at a time."""
        self.n += 1
        path, schema = f"{self.path}/{self.n}", None
        for df in parts:
            df.write.mode("append").option("compression", "zstd").parquet(path)
            schema = df.schema
        out = self.spark.read.schema(schema).parquet(path)
        out._stage_path = path
        del df
        gc.collect()  # lets Spark's cleaner delete the shuffle files behind the table
        self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._stage_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(docs: DataFrame) -> Column:
    """A whole row as one struct: names in it can't clash with an operator's own columns."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def unpacked(df: DataFrame, names: list[str], changed: dict[str, Column]) -> DataFrame:
    """The columns of packed rows, some of them changed."""
    return df.select(*(changed.get(c, F.col("_row").getField(c)).alias(c) for c in names))


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in it if b.num_rows)
