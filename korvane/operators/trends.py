"""Yearly series: dense windows, Theil-Sen momentum, rising people, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Years of a window, the least typical year, the year under which a percentage says little.
YEARS, TYPICAL, TINY = 5, 10, 25


def window(series: DataFrame, last: int, years: int = YEARS) -> DataFrame:
    """id and the values, in order, of the ``years`` years before ``last`` (series of id, y, n); none for an id that lacks one of them."""
    held = series.where((F.col("y") >= last - years) & (F.col("y") < last)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("p"))  # ``years`` at most
    return held.where(F.size("p") == years).select("id", F.transform("p", lambda x: x["n"].cast("double")).alias("series"))


def _slopes() -> Column:
    i = F.sequence(F.lit(0), F.size("series") - 1)
    later = lambda a: F.filter(i, lambda b: b > a)
    slope = lambda a, b: (F.log1p(F.get("series", b)) - F.log1p(F.get("series", a))) / (b - a)
    return F.array_sort(F.flatten(F.transform(i, lambda a: F.transform(later(a), lambda b: slope(a, b)))))


def _median(a: str) -> Column:
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2


def momentum(series: DataFrame, last: int, years: int = YEARS) -> DataFrame:
    """id, slope, p25, pct, typical, latest, rising and glyph of each dense window.

    ``slope`` is the median of all pairwise slopes of log(1 + n); ``pct`` its growth a year, rounded half to even; ``p25``
    the nearest-rank quarter of the slopes. Rising: a typical year of TYPICAL or more, a positive slope, and p25 not
    under 0. ``glyph``: the latest year is too small, or the growth too little, for a percentage.
    """
    s = window(series, last, years).withColumn("slopes", _slopes()).withColumn("sorted", F.array_sort("series"))
    pct = F.bround((F.exp("slope") - 1) * 100, 0).cast("long")
    told = s.select("id", _median("slopes").alias("slope"), F.get("slopes", (F.ceil(F.size("slopes") * 0.25) - 1).cast("int")).alias("p25"), _median("sorted").alias("typical"), F.element_at("series", -1).cast("long").alias("latest"))
    rising = (F.col("typical") >= TYPICAL) & (F.col("slope") > 1e-9) & (F.col("p25") >= -1e-12)
    return told.withColumn("pct", pct).withColumn("rising", rising).withColumn("glyph", (F.col("latest") < TINY) | (F.col("pct") < 1))


def peak(series: DataFrame, all_time: DataFrame) -> DataFrame:
    """id, y, n, is_all_time: the best year (the earlier of equals); all-time only if it beats every year known outside the series (id, best)."""
    w = Window.partitionBy("id").orderBy(F.desc("n"), "y")
    top = series.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "y", "n")
    return top.join(all_time.groupBy("id").agg(F.max("best").alias("best")), "id", "left").select("id", "y", "n", (F.col("n") > F.coalesce("best", F.lit(0))).alias("is_all_time"))
