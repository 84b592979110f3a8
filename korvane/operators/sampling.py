"""Stratified samples: quotas by largest remainders, items in one stratum only, drawn by a seeded hash.

Nothing is ordered as a whole: a stratum's hash range is cut into :data:`PARTS`, whole parts below the quota are taken as they are, and
only the part in which the quota ends is ordered. The draw depends on ids and seed alone, not on partitions.

Defined results: an item in several strata counts in the first one of the given order (of the alphabet, where none is
given); null ids and strata are left out; repeated rows are one item; a stratum of fewer items than its quota gives all of
them; a sample of no or negative size is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.operators.order import places

PARTS = 1024


def placed(items: DataFrame, first: list[str] | None = None) -> DataFrame:
    """id, stratum: each item of (id, stratum) once."""
    rows = items.where(F.col("id").isNotNull() & F.col("stratum").isNotNull())
    rank = F.coalesce(F.nullif(F.array_position(F.lit(list(first)) if first else F.array().cast("array<string>"), F.col("stratum")), F.lit(0)), F.lit(1 << 30))
    return rows.groupBy("id").agg(F.min(F.struct(rank.alias("r"), "stratum")).alias("s")).select("id", "s.stratum")


def quotas(sizes: DataFrame, n: int) -> DataFrame:
    """stratum, size, quota of strata (stratum, size): shares of ``n`` in proportion, rounded down, and one more for the largest remainders, so that they sum to n (to all, if there are fewer)."""
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()["total"]
    n = max(0, min(n, total))
    share = f"cast({n} as decimal(20)) * size"  # exact, whatever the sizes
    told = sizes.select("stratum", "size", *(F.expr(f"cast(({share}) {op} {max(total, 1)} as long)").alias(c) for c, op in (("low", "div"), ("rest", "%"))))
    left = n - (told.agg(F.coalesce(F.sum("low"), F.lit(0)).alias("low")).first()["low"])
    order = places(told, [F.desc("rest"), F.col("stratum")])
    return order.select("stratum", "size", (F.col("low") + (F.col("place") <= left).cast("long")).alias("quota"))


def draw(items: DataFrame, quota: DataFrame, seed: int = 0) -> DataFrame:
    """id, stratum: of each stratum's items (id, stratum, once each) its quota, by seeded hash."""
    h: Column = F.xxhash64(F.lit(seed), F.col("id"))
    rows = items.withColumn("h", h).withColumn("part", F.shiftrightunsigned("h", 54))
    parts = rows.groupBy("stratum", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("stratum").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows at most
    told = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(quota.select("stratum", "quota"), "stratum")
    kept = told.where(F.col("before") < F.col("quota")).select("stratum", "part", F.when(F.col("before") + F.col("n") > F.col("quota"), F.col("quota") - F.col("before")).alias("room"))
    met = rows.join(kept, ["stratum", "part"])
    last = Window.partitionBy("stratum").orderBy("h", "id")
    whole, edge = met.where("room is null"), met.where("room is not null")  # one part of each stratum at most is ordered
    ranked = edge.withColumn("r", F.row_number().over(last)).where(F.col("r") <= F.col("room"))
    return whole.select("id", "stratum").unionByName(ranked.select("id", "stratum"))


def stratified(items: DataFrame, n: int, seed: int = 0, first: list[str] | None = None) -> DataFrame:
    """id, stratum: a sample of ``n`` items of (id, stratum), strata in proportion to their sizes."""
    once = placed(items, first)
    return draw(once, quotas(once.groupBy("stratum").agg(F.count("*").alias("size")), n), seed)
