"""Judging: leaderboards, sequences, progress, agreement of a labelled run, debt reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.operators.order import places, ranks
from korvane.operators.retrieval import quantised


def averages(presenters: DataFrame, scores: DataFrame, keys: list[str], score: str, least: int) -> DataFrame:
    """keys, score, n and low_coverage: the mean of each presenter's scores; none without any, and low under ``least``.

    Scores are summed as decimals (to a billionth), so that equal scores give equal means in whatever order they come; presenters
    with a score that no decimal holds (of 19 digits and more, or not finite) have the mean of doubles.
    """
    joined = presenters.select(*keys).join(scores.select(keys[-1], F.col(score).alias("_s")), keys[-1], "left")
    exact = F.col("_s").try_cast("decimal(28,9)")
    told = joined.groupBy(*keys).agg(F.avg("_s").alias("_mean"), F.sum(exact).cast("double").alias("_sum"), F.count(exact).alias("_held"), F.count("_s").alias("n"))
    mean = F.when((F.col("n") > 0) & (F.col("_held") == F.col("n")), F.col("_sum") / F.col("n")).otherwise(F.col("_mean"))
    return told.select(*keys, mean.alias("score"), "n", (F.col("n") < least).alias("low_coverage"))


def leaderboard(presenters: DataFrame, scores: DataFrame, keys: list[str], score: str, least: int) -> DataFrame:
    """:func:`averages` with standard competition ranks within the first key; a presenter without a score has none."""
    return ranks(averages(presenters, scores, keys, score, least), "score", keys[0]).withColumn("score", quantised(F.col("score")))


def scored_sequence(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """``rows`` with a place, 1, 2, 3, among those with a ``key``; the rest has none."""
    held = places(rows.withColumn("_key", key).where("_key is not null"), [F.col("_key").desc(), *order]).drop("_key")
    return held.unionByName(rows.where(key.isNull()).withColumn("place", F.lit(None).cast("long")))


def agreement(rows: DataFrame, group: str, truth: str, told: str) -> DataFrame:
    """group, n, agree, rate and worst: how often ``told`` equals ``truth`` (nulls are a value), and the commonest confusion."""
    t, p = F.coalesce(F.col(truth).cast("string"), F.lit("none")), F.coalesce(F.col(told).cast("string"), F.lit("none"))
    pairs = rows.groupBy(group, t.alias("t"), p.alias("p")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "t", "p")
    wrong = pairs.where("t <> p").withColumn("r", F.row_number().over(w)).where("r = 1").select(group, F.concat_ws(">", "t", "p").alias("worst"))
    summed = pairs.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("agree"))
    return summed.withColumn("rate", quantised(F.col("agree") / F.col("n"))).join(wrong, group, "left").select(group, "n", "agree", "rate", "worst")


def confusion(rows: DataFrame, truth: str, told: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, miss_rate and leaks of a binary run: a leak is a positive that was told negative; nulls take no part."""
    y, p = F.col(truth) == 1, F.col(told) == 1
    both = rows.where(F.col(truth).isNotNull() & F.col(told).isNotNull())
    counts = both.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p))))
    total, positive = sum((F.col(c) for c in ("fp", "fn", "tn")), F.col("tp")), F.col("tp") + F.col("fn")
    rate = lambda a, b: F.when(b > 0, quantised(a / b))
    return counts.withColumn("accuracy", rate(F.col("tp") + F.col("tn"), total)).withColumn("miss_rate", rate(F.col("fn"), positive)).withColumn("leaks", F.col("fn"))


def debt(facts: DataFrame, least: float) -> DataFrame:
    """stratum, facts, paid, owed, unknown, ratio and over: what of the facts (stratum, verdict) a run still owes, and whether it is over ``least``."""
    count = lambda c: F.count(F.when(c, 1))
    owed, paid = count(F.col("verdict") == "owed"), count(F.col("verdict") == "paid")
    told = facts.groupBy("stratum").agg(F.count("*").alias("facts"), paid.alias("paid"), owed.alias("owed"), count(F.col("verdict").isNull()).alias("unknown"))
    judged = F.col("paid") + F.col("owed")
    ratio = F.when(judged > 0, quantised(F.col("owed") / judged))
    return told.withColumn("ratio", ratio).withColumn("over", F.coalesce(F.col("ratio") > least, F.lit(False)))


def calibration(rows: DataFrame, score: str, good: Column) -> DataFrame:
    """score, covered and precision_so_far at each distinct score, from the highest down: the table that a threshold is chosen from."""
    from korvane.operators.order import running

    cuts = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.count(F.when(good, 1)).alias("g"))
    told = running(cuts, [F.desc(score)], {"covered": F.col("n"), "right": F.col("g")})
    return told.select(score, "covered", quantised(F.col("right") / F.col("covered")).alias("precision_so_far"))


def validated(rows: DataFrame, scores: str, criteria: int, low: float, high: float) -> DataFrame:
    """The rows with ``fault`` (null where scores are usable: one a criterion, each in range) and ``final_score``, their mean.

    Null arrays and null scores are faults; an empty array is one unless no criteria are asked, and then has no mean.
    """
    s = F.col(scores)
    fault = (
        F.when(s.isNull() | (F.size(s) != criteria), "count")
        .when(F.exists(s, lambda x: x.isNull()), "missing")
        .when(F.exists(s, lambda x: (x < low) | (x > high)), "range")
    )
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(s), F.lit(0))
    return rows.withColumn("fault", fault).withColumn("final_score", F.when(F.col("fault").isNull(), mean))


#: Skills that end a conversation with one value, told wrongly at the highest price.
TERMINAL = ("metric_of_person", "link_of_person")


def _pairs(runs: DataFrame, kind: str) -> tuple[Column, Column, Column]:
    gold, told = F.col("gold_family") == kind, F.coalesce(F.col("told_family") == kind, F.lit(False))
    return gold, told, F.col("gold_skill").eqNullSafe(F.col("told_skill"))


def dispatch(runs: DataFrame, structured: str = "KG", terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """One row of a judged run (gold_family, gold_skill, told_family, told_skill): n, accuracies, and what went wrong.

    skill_accuracy is over questions of the structured family that were told it (null without any).
    structured_false_negative: structured questions told another family; wrong_confident_exact: told a wrong skill;
    false_honest_partial: told a terminal skill where none was asked. Rows without a gold family take no part; an empty run has n 0 and family_accuracy 0.
    """
    gold, told, same = _pairs(runs, structured)
    ends = F.coalesce(F.col("told_skill").isin(*terminal), F.lit(False))
    asked = gold & F.coalesce(F.col("gold_skill").isin(*terminal), F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    sums = runs.where("gold_family is not null").agg(
        F.count("*").alias("n"), count(F.col("gold_family").eqNullSafe(F.col("told_family"))).alias("_f"), count(gold & told).alias("_k"), count(gold & told & same).alias("_s"),
        count(gold & ~told).alias("structured_false_negative"), count(ends & ~asked).alias("false_honest_partial"), count(gold & told & ~same).alias("wrong_confident_exact"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, quantised(F.col(a) / F.col(b)))
    return sums.select("n", F.coalesce(rate("_f", "n"), F.lit(0.0)).alias("family_accuracy"), rate("_s", "_k").alias("skill_accuracy"), "structured_false_negative", "false_honest_partial", "wrong_confident_exact")


def dispatch_confusion(runs: DataFrame, structured: str = "KG") -> DataFrame:
    """gold_skill, told_skill, n of the structured questions that were told the structured family."""
    gold, told, _ = _pairs(runs, structured)
    return runs.where(gold & told).groupBy("gold_skill", "told_skill").agg(F.count("*").alias("n"))


def slot_scores(asked: DataFrame, gold: DataFrame, told: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """skill (null: all together), n, tp, fp, fn, precision, recall, f1, exact of filled slots.

    asked (id, skill) are the judged questions; gold and told (id, slot, value) their slots, compared as sets of pairs with trimmed,
    lower-cased values; null and empty values are no slots, and slots out of ``keys`` (where given) are notes. A question told
    nothing loses recall. Without any pair on either side all rates are 1; without gold ones recall is 1; exact is the share of
    questions whose sets are equal. Slots of questions not in ``asked`` are left out; ids are distinct, a repeated one counts once.
    """
    def pairs(df: DataFrame, side: int) -> DataFrame:
        value = F.lower(F.trim("value"))
        held = df.where(F.col("slot").isin(*keys)) if keys else df
        return held.select("id", F.col("slot").cast("string").alias("slot"), value.alias("value"), F.lit(side).alias("side")).where("value <> ''")

    # the sides meet by aggregation, not in a join: 1 is gold only, 2 told only, 3 both; null slots and ids never meet
    sides = pairs(gold, 1).unionByName(pairs(told, 2)).groupBy("id", "slot", "value").agg(F.bit_or("side").alias("side"))
    count = lambda c: F.count(F.when(c, 1))
    meets = (F.col("side") == 3) & F.col("slot").isNotNull()
    each = sides.groupBy("id").agg(count(meets).alias("tp"), count((F.col("side") >= 2) & ~meets).alias("fp"), count(F.col("side").isin(1, 3) & ~meets).alias("fn"))
    base = asked.where("id is not null").groupBy("id").agg(F.min("skill").alias("skill")).join(each, "id", "left").fillna(0, ["tp", "fp", "fn"])
    # one row a skill and one for all: the grouping id tells a null skill from the total
    summed = base.withColumn("skill", F.coalesce("skill", F.lit(""))).rollup("skill").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), count(F.col("fp") + F.col("fn") == 0).alias("_e"))
    c = F.col
    p = F.when(c("tp") + c("fp") > 0, c("tp") / (c("tp") + c("fp"))).when(c("fn") == 0, 1.0).otherwise(0.0)
    r = F.when(c("tp") + c("fn") > 0, c("tp") / (c("tp") + c("fn"))).otherwise(1.0)
    rated = summed.withColumn("_p", p).withColumn("_r", r)
    f1 = F.when(c("_p") + c("_r") > 0, 2 * c("_p") * c("_r") / (c("_p") + c("_r"))).otherwise(0.0)
    return rated.select("skill", "n", "tp", "fp", "fn", quantised(c("_p")).alias("precision"), quantised(c("_r")).alias("recall"), quantised(f1).alias("f1"), quantised(c("_e") / c("n")).alias("exact"))
