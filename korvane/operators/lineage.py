"""Cuts of the lineage between rounds of iterative operators."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from korvane.store.tables import Files, shared_base

_folders: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """One folder a session under the shared base; it goes when the driver ends, or with :func:`sweep`."""
    own = spark.sparkContext.applicationId
    if own not in _folders:
        _folders[own] = f"{shared_base(spark)}/lineage-{uuid.uuid4().hex}"

        def forget() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone already
                sweep(spark)

        atexit.register(forget)
    return _folders[own]


def cut(df: DataFrame) -> DataFrame:
    """``df``, written as a table of the shared folder and read again: a lost executor costs what comes after, and scans read only the columns they need."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Deletes all tables of :func:`cut`; what was read from them can't be used any more."""
    own = spark.sparkContext.applicationId
    if own in _folders:
        Files(spark, _folders.pop(own)).delete("")
