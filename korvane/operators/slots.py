"""Slots of a question: mentions grounded in its words, people by a ladder of tiers, and a plan or an abstention."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from korvane.functions.fuzzy import CUT, fuzzy_names


@F.pandas_udf(BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    import difflib

    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() >= 0.8 for x, y in zip(a, b, strict=True)], dtype="boolean")


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " "), lambda w: F.length(w) > 1)


def grounded(mentions: DataFrame) -> DataFrame:
    """(id, grounded): whether a mention occurs in its message (id, mention, message).

    One word of the mention must equal one of the message, contain it or lie in it (three letters or more each), or be
    0.8 alike to it. Exact rules come first; only pairs of words that these leave open are compared letter by letter.
    """
    m, q = words(F.col("mention")), words(F.col("message"))
    inside = lambda x, y: (F.length(x) >= 3) & (F.length(y) >= 3) & (F.contains(x, y) | F.contains(y, x))
    plain = F.exists("m", lambda x: F.exists("q", lambda y: (x == y) | inside(x, y)))
    told = mentions.select("id", m.alias("m"), q.alias("q")).withColumn("plain", plain)
    pairs = told.where(~F.col("plain")).select("id", F.explode(F.array_distinct("m")).alias("x"), "q").select("id", "x", F.explode(F.array_distinct("q")).alias("y"))
    # two words 0.8 alike differ in length by no more than half of the shorter one
    possible = pairs.where(F.greatest(F.length("x"), F.length("y")) * 2 <= F.least(F.length("x"), F.length("y")) * 3)
    known = possible.select("x", "y").distinct().where(_near("x", "y"))  # each pair of words is compared once
    alike = possible.join(known, ["x", "y"], "left_semi").select("id").distinct().withColumn("alike", F.lit(True))
    return told.join(alike, "id", "left").select("id", (F.col("plain") | F.coalesce("alike", F.lit(False))).alias("grounded"))


def _least(people: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``keys`` and persons: the ``most`` smallest distinct persons of each key, sorted. Partial limits go before the shuffle, so no key brings all its rows to a task."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("person")))
    kept = people.select(*keys, "person").distinct().withColumn("_r", first).where(F.col("_r") <= most)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list("person")).alias("persons"))


def person_slots(asked: DataFrame, people: DataFrame, orgs: DataFrame, margin: float = 5.0, most: int = 5, cut: float = CUT) -> DataFrame:
    """(id, status, person, via, candidates) of each asked name (id, name, message) among people (person, name, org).

    Tiers: the exact name; for a single word, the surname; then names that are alike. One hit is taken; several are
    ambiguous. A name that is only alike is never taken by itself: it counts within ``margin`` of the best and only if
    the message names the organisation (org, org_name) of exactly one of these; otherwise it is a candidate.

    Rows of one name and message have one answer, which is found once; of the people of a name only the smallest that can
    be told (``most``, and two to know that there are several) meet it. So work grows with distinct names, not with namesakes.
    """
    held = max(most, 2)
    q = asked.select("id", F.lower(F.trim("name")).alias("q"), F.concat(F.lit(" "), F.lower("message"), F.lit(" ")).alias("message"))
    p = people.select("person", F.lower("name").alias("known"), "org", F.element_at(F.split(F.lower("name"), " "), -1).alias("surname"))
    asks = q.select("q", "message").distinct()
    names, known = asks.select("q").distinct(), p.select("known", "surname").distinct()
    exact = names.join(known, names["q"] == known["known"]).select("q", "known", F.lit(0).alias("tier"), F.lit(100.0).alias("score"))
    last = names.where(~F.contains("q", F.lit(" "))).join(known, names["q"] == known["surname"]).select("q", "known", F.lit(1).alias("tier"), F.lit(100.0).alias("score"))
    sure = exact.unionByName(last)
    open_ = names.join(sure.select("q").distinct(), "q", "left_anti")
    alike = fuzzy_names(open_.select(F.col("q").alias("name")), known.select(F.col("known").alias("name")), cut)
    every = sure.unionByName(alike.select(F.col("asked").alias("q"), "known", F.lit(2).alias("tier"), F.col("ratio").alias("score")))
    own = Window.partitionBy("q")
    kept = every.withColumn("first", F.min("tier").over(own)).where("tier = first").withColumn("top", F.max("score").over(own)).where(F.col("top") - F.col("score") <= margin).select("q", "known", "tier")
    pool = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, held)
    summed = kept.join(_least(p, ["known"], held), "known").groupBy("q", "tier").agg(pool("persons").alias("persons"))
    # only names that are alike ask for an organisation
    named = _least(p.join(orgs.select("org", F.lower("org_name").alias("org_name")), "org").where("org_name is not null"), ["known", "org_name"], held)
    meant = kept.where("tier = 2").join(asks.where("message is not null"), "q").join(named, "known").where(F.contains("message", F.concat(F.lit(" "), "org_name", F.lit(" "))))
    fits = meant.groupBy("q", "message").agg(pool("persons").alias("fits"))
    told = asks.join(summed, "q").join(fits, ["q", "message"], "left")
    one = lambda c: F.when(F.size(c) == 1, F.col(c)[0])
    told = told.select("q", "message", "tier", "persons", F.when(F.col("tier") < 2, one("persons")).otherwise(one("fits")).alias("person"))
    # null names and messages meet themselves
    a, b = q.alias("a"), told.alias("b")
    told = a.join(b, F.col("a.q").eqNullSafe(F.col("b.q")) & F.col("a.message").eqNullSafe(F.col("b.message")), "left").select("id", "tier", "person", F.slice(F.col("persons"), 1, most).alias("candidates"))
    status = F.when(F.col("tier").isNull(), "none").when(F.col("person").isNotNull(), "ok").otherwise("ambiguous")
    via = F.when(F.col("person").isNotNull(), F.when(F.col("tier") == 2, "fuzzy").otherwise("exact"))
    return told.select("id", status.alias("status"), "person", via.alias("via"), F.when(status == "ambiguous", F.array_join("candidates", ",")).alias("candidates"))


def plans(slots: DataFrame, support: DataFrame, needs: dict[str, list[str]], least: int = 3) -> DataFrame:
    """(id, verdict, reason) of filled slots (id, skill, person, org, area): execute, or abstain and why.

    ``needs`` names the slots of each skill. A skill that is unknown or lacks a slot abstains; so does an area with
    fewer than ``least`` people behind it (area, n).
    """
    lacking = F.lit(None).cast("string")
    for skill, wanted in sorted(needs.items()):
        for slot in reversed(wanted):
            lacking = F.when((F.col("skill") == skill) & F.col(slot).isNull(), f"missing {slot}").otherwise(lacking)
    thin = F.lit(False)
    for skill, wanted in sorted(needs.items()):
        if "area" in wanted:
            thin |= (F.col("skill") == skill) & (F.coalesce("n", F.lit(0)) < least)
    reason = F.when(F.col("skill").isNull() | ~F.col("skill").isin(*sorted(needs)), "unknown skill").when(lacking.isNotNull(), lacking).when(thin, "thin area")
    told = slots.join(support.select("area", "n"), "area", "left").withColumn("reason", reason)
    return told.select("id", F.when(F.col("reason").isNull(), "execute").otherwise("abstain").alias("verdict"), "reason")
