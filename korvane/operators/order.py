"""Places, ranks and running totals over whole tables, without a window that one task would have to hold.

A table is sorted by ranges; each range counts and sums for itself, and the totals of the ranges before it (a row a range)
are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.operators.lineage import cut

#: Distinct keys of a group that one task may order.
SMALL = 1_000_000


def running(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``values``, its sum up to and with the row, in the order of the whole table. Rows equal in ``order`` come in any order."""
    names = list(values)
    rows = cut(df.orderBy(*order).select("*", *(values[n].alias(f"_v{i}") for i, n in enumerate(names)), F.monotonically_increasing_id().alias("_at")))
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    totals = rows.groupBy("_range").agg(*(F.sum(f"_v{i}") for i in range(len(names)))).orderBy("_range").collect()  # a row a range
    before, so_far = [], [0] * len(names)
    for r in totals:
        before.append((r["_range"], *so_far))
        so_far = [x + (y or 0) for x, y in zip(so_far, list(r)[1:], strict=True)]
    base = F.broadcast(df.sparkSession.createDataFrame(before, ", ".join(["_range long", *(f"_b{i} long" for i in range(len(names)))])))
    own = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [(F.sum(f"_v{i}").over(own) + F.col(f"_b{i}")).alias(n) for i, n in enumerate(names)]
    return rows.join(base, "_range").select(*df.columns, *sums)


def places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in the order of the whole table."""
    return running(df, order, {name: F.lit(1).cast("long")})


def ranks(df: DataFrame, key: str, group: str | None = None, descending: bool = True, name: str = "place") -> DataFrame:
    """``df`` with standard competition ranks (1, 1, 3) by ``key``, in the whole table or within ``group``; a null key has none.

    Only distinct keys are ordered, with their counts, so ties never fall to one task. Groups of up to :data:`SMALL` distinct keys
    are ordered each by itself; groups with more, and the whole table, by ranges.
    """
    way = F.col(key).desc() if descending else F.col(key).asc()
    held = [group] if group else []
    counted = df.where(F.col(key).isNotNull()).groupBy(*held, key).agg(F.count("*").alias("_n"))
    if group:
        counted = cut(counted)
        many = counted.groupBy(group).agg(F.count("*").alias("_keys")).where(F.col("_keys") > SMALL).select(group)
        before = Window.partitionBy(group).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)
        if not many.limit(1).count():
            seen = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        else:
            large = F.col("_large").isNotNull()
            told = counted.join(many.select(F.col(group).alias("_large")), F.col(group).eqNullSafe(F.col("_large")), "left")
            few = told.where(~large).drop("_large").withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            wide = _ranged(told.where(large).drop("_large"), [F.col(group), way])
            seen = few.unionByName(wide.join(wide.groupBy(group).agg(F.min("_before").alias("_first")), group).withColumn("_before", F.col("_before") - F.col("_first")).drop("_first", "_upto"))
    else:
        seen = _ranged(counted, [way])
    return df.join(seen.select(*held, key, (F.col("_before") + 1).alias(name)), [*held, key], "left").select(*df.columns, name)


def _ranged(counted: DataFrame, order: list[Column]) -> DataFrame:
    return running(counted, order, {"_upto": F.col("_n")}).withColumn("_before", F.col("_upto") - F.col("_n"))


def top_with_ties(df: DataFrame, key: str, n: int, descending: bool = True, name: str = "place") -> DataFrame:
    """The rows of rank ``n`` or better: the first n, and all that tie with the last of them."""
    order = F.col(key).desc() if descending else F.col(key).asc()
    first = df.where(F.col(key).isNotNull()).select(key).orderBy(order).limit(n)
    edge = first.agg(F.min(key) if descending else F.max(key)).first()[0]  # one value
    if edge is None:
        return df.limit(0).withColumn(name, F.lit(None).cast("long"))
    held = df.where(F.col(key) >= F.lit(edge) if descending else F.col(key) <= F.lit(edge))
    counted = held.groupBy(key).agg(F.count("*").alias("_n"))  # n keys at most
    before = F.coalesce(F.sum("_n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(counted.select(key, (before + 1).cast("long").alias(name))), key).select(*df.columns, name)
