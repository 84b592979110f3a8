"""Fuzzy name matching: the normalised indel ratio, with candidates from shared letter pairs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

CUT = 86.0


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a column of the table is one integer, so a letter costs one addition."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = open_ = (1 << len(a)) - 1
    for y in b:
        hit = open_ & places.get(y, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return len(a) - open_.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 x the longest common subsequence over the joint length; 100 for two empty texts."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the words in common and these with what is left of either side; 100 where one side's words are all in common, 0 without words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one, two = (" ".join([both, *sorted(z)]).strip() for z in (x - y, y - x))
    pairs = [(one, two)] + ([(both, one), (both, two)] if both else [])
    return max(indel_ratio(p, q) for p, q in pairs)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`token_set_ratio` of two columns."""
    return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _pairs(name: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, 2)))


def fuzzy_names(asked: DataFrame, known: DataFrame, cut: float = CUT) -> DataFrame:
    """(asked, known, ratio, place): known names at ``cut`` or more, best first. Names are made distinct first.

    Lossless at 86 and more: of L common letters, more than the gaps that the letters outside them can break lie side by side, so such
    names share a letter pair; names of one letter meet by equality. Work grows with the pairs of distinct names that share a letter
    pair, so ``known`` is meant to be a dictionary of people or organisations, not a corpus. Null names take no part.
    """
    a = asked.select(F.lower("name").alias("asked")).where("asked IS NOT NULL").distinct()
    k = known.select(F.lower("name").alias("known")).where("known IS NOT NULL").distinct()
    met = a.withColumn("p", F.explode(_pairs(F.col("asked")))).join(k.withColumn("p", F.explode(_pairs(F.col("known")))), "p").select("asked", "known").distinct()
    w = Window.partitionBy("asked").orderBy(F.desc("ratio"), "known")
    return met.withColumn("ratio", _ratio("asked", "known")).where(F.col("ratio") >= cut).withColumn("place", F.row_number().over(w))


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, asked with the third letter missing, against the names as they are."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name"))
    return fuzzy_names(names.select(F.concat(F.substring("name", 1, 2), F.expr("substring(name, 4)")).alias("name")), names)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"x05_fuzzy_names": _query}
