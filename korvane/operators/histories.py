"""Lists and walks within one key: highlights of papers, versions of an item, running scores of a match.

Each is a window over its key, which sorts within a partition and spills; keys are people, items and matches, so groups are small
against the table, and the exchange is by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korvane.operators.lineage import cut


def highlights(papers: DataFrame, year: int, cited: int = 5, newest: int = 5, current: int = 10) -> DataFrame:
    """person, list, place, paper, title, year, cited: the most cited, the newest, and this year's papers of each person.

    papers: person, paper (a cluster; where null, title and year tell papers apart), title, year, cited. Of a paper met several times
    the row with most citations counts (ties: smallest title, then latest year). Null citations count as 0; papers without a
    year are in the first list only; ties in a list go to the smaller title, then paper. Rows without a person are left out.
    """
    c = F.col
    rows = papers.where("person is not null").select("person", "paper", "title", "year", F.coalesce("cited", F.lit(0)).alias("cited"))
    key = F.coalesce(F.concat(F.lit("p"), c("paper").cast("string")), F.concat(F.lit("t"), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce(c("year").cast("string"), F.lit(""))))
    one = Window.partitionBy("person", key).orderBy(F.desc("cited"), "title", F.desc_nulls_last("year"))
    kept = cut(rows.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r"))
    # each list by itself: what cannot be in it leaves before the shuffle, so a person's papers never lie sorted three times in one task
    own, rank = Window.partitionBy("person"), (F.desc("cited"), c("title"), c("paper"))
    dated = kept.where("year is not null")
    lists = (("top_cited", kept, rank, cited), ("newest", dated, (F.desc("year"), *rank), newest), ("current_year", dated.where(c("year") == year), rank, current))
    placed = (df.withColumn("place", F.row_number().over(own.orderBy(*order))).where(c("place") <= n).select("person", F.lit(name).alias("list"), "place", "paper", "title", "year", "cited") for name, df, order, n in lists)
    return reduce(DataFrame.unionByName, placed)


def versions(items: DataFrame) -> DataFrame:
    """id, root, version, place (1: the newest), state (current, superseded), latest and restores of items (id, root_id, version, active).

    An item without a root_id is its own root. ``restores`` is the current item that restoring an old one would replace: null for the
    current one, and where none is. Ties in version go to the larger id; null versions are oldest. Rows without an id are left out.
    """
    rows = items.where("id is not null").select("id", F.coalesce("root_id", "id").alias("root"), "version", F.coalesce("active", F.lit(False)).alias("active"))
    w = Window.partitionBy("root")
    order = w.orderBy(F.desc_nulls_last("version"), F.desc("id"))
    current = F.max(F.when(F.col("active"), F.struct("version", "id"))).over(w)["id"]
    told = rows.withColumn("place", F.row_number().over(order)).withColumn("latest", F.max("version").over(w)).withColumn("_c", current)
    return told.select("id", "root", "version", "place", F.when(F.col("active"), "current").otherwise("superseded").alias("state"), "latest", F.when(~F.col("active"), F.col("_c")).alias("restores"))


def running_scores(goals: DataFrame, order: list[str]) -> DataFrame:
    """The goals (match, team, away: the match's away team, and ``order``) with home_score and away_score after each.

    A goal counts for the away team where the team it is credited to is that one, else (null included) for the home team; so an own goal
    counts for whom it helps. ``order`` should tell goals of a match apart.
    """
    side = F.coalesce(F.col("team") == F.col("away"), F.lit(False)).cast("long")
    w = Window.partitionBy("match").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return goals.withColumn("away_score", F.sum(side).over(w)).withColumn("home_score", F.sum(1 - side).over(w))
