"""How sure a measured share is, and how many questions a wanted margin takes: intervals over clusters, sample sizes, power by stage.

Records are facts: (question, stage, missed). A share is that of missed facts; questions are the clusters, since facts of one
question hang together.

Defined results: without records the share is 0 with an interval of 0 to 0; null questions are left out, a null ``missed`` is not
missed; questions of no facts do not occur; sizes that can't be computed (no facts a question, no margin) are null or the number at hand, as stated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The normal quantile of a 95 % interval, and the margin asked of a stage's share.
Z, STAGE_MARGIN = 1.96, 0.10
DRAWS = 2000


def required_facts(share: Column, margin: float, z: float = Z) -> Column:
    """Facts for a margin, were they independent: z² p (1 - p) / margin², rounded half to even."""
    return F.bround(z * z * share * (1 - share) / (margin * margin), 0).cast("long")


def required_questions(share: Column, facts_per_question: Column, margin: float, z: float = Z) -> Column:
    """The same in questions; null without facts a question."""
    facts = z * z * share * (1 - share) / (margin * margin)
    return F.when(facts_per_question > 0, F.bround(facts / facts_per_question, 0).cast("long"))


def questions_for_margin(half_width: Column, questions: Column, margin: float) -> Column:
    """Questions for a margin, given the half width that so many questions have: it falls with the root of their number; never fewer than there are."""
    more = F.ceil(questions * F.pow(half_width / margin, F.lit(2.0))).cast("long")
    return F.when(F.lit(margin <= 0) | (half_width <= 0) | (questions <= 0), questions).otherwise(F.greatest(questions, more))


def clusters(records: DataFrame) -> DataFrame:
    """question, facts, missed: what a question brings to any draw."""
    told = records.where(F.col("question").isNotNull())
    return told.groupBy("question").agg(F.count("*").alias("facts"), F.sum(F.coalesce("missed", F.lit(False)).cast("long")).alias("missed"))


def bootstrap(records: DataFrame, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """share, low, high, half_width, questions, facts: the share with a percentile interval over resampled questions.

    Each question is drawn by Poisson counts of its own, seeded by the question, so draws depend neither on partitions nor on
    order; a task adds up all draws of its questions, and a row a draw and task is what travels.
    """
    own = clusters(records)
    schema = "draw int, facts double, missed double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, draws))
        for b in it:
            for h, facts, missed in zip(*(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)), strict=True):
                w = np.random.Generator(np.random.PCG64([seed, int(h) & (2**63 - 1)])).poisson(1.0, draws)
                total += np.outer((facts, missed), w)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], names=["draw", "facts", "missed"])

    drawn = own.select(F.xxhash64("question"), F.col("facts").cast("double"), F.col("missed").cast("double")).mapInArrow(run, schema)
    shares = drawn.groupBy("draw").agg((F.coalesce(F.sum("missed") / F.nullif(F.sum("facts"), F.lit(0.0)), F.lit(0.0))).alias("s"))
    order = F.array_sort(F.collect_list("s"))  # ``draws`` numbers
    ends = shares.agg(order.alias("o")).select(*(F.coalesce(F.get("o", F.lit(int(p * draws))), F.lit(0.0)).alias(n) for p, n in ((0.025, "low"), (0.975, "high"))))
    point = own.agg(F.count("*").alias("questions"), F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"), F.coalesce(F.sum("missed") / F.sum("facts"), F.lit(0.0)).alias("share"))
    return point.crossJoin(ends).select("share", "low", "high", ((F.col("high") - F.col("low")) / 2).alias("half_width"), "questions", "facts")  # one row each


def power(records: DataFrame, margins: tuple[float, ...] = (0.05, 0.10), draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """:func:`bootstrap` with, for each margin in per cent, ``questions_<m>`` (from the interval) and ``facts_<m>`` (were facts independent)."""
    told = bootstrap(records, draws, seed)
    for m in margins:
        name = f"{round(100 * m)}"
        told = told.withColumn(f"questions_{name}", questions_for_margin(F.col("half_width"), F.col("questions"), m)).withColumn(f"facts_{name}", F.when(F.col("facts") > 0, required_facts(F.col("share"), m)))
    return told


def by_stage(records: DataFrame) -> DataFrame:
    """stage, misses, share, questions: each stage's part of the misses, and the questions for ten per cent more or less of it.

    The variance is that of the Agresti-Coull proportion, (misses + 2) / (all + 4), so that a stage with all misses is not sure.
    """
    sizes = clusters(records).agg((F.sum("facts") / F.count("*")).alias("per"), F.sum("missed").alias("all"))
    stages = records.where(F.col("question").isNotNull() & F.coalesce("missed", F.lit(False))).groupBy("stage").agg(F.count("*").alias("misses"))
    adjusted = (F.col("misses") + 2) / (F.col("all") + 4)
    told = stages.crossJoin(F.broadcast(sizes))  # one row of totals
    return told.select("stage", "misses", (F.col("misses") / F.col("all")).alias("share"), required_questions(adjusted, F.col("per"), STAGE_MARGIN).alias("questions"))
