"""Phrases and token sets held against whole texts, through an inverted index of the asked tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.operators.retrieval import asked_tokens, quantised, tokens


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def covering(asked: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """item_id, doc_id, overlap: documents that hold at least the share ``least`` of an item's tokens (asked: item_id, token, distinct).

    A document that holds enough must hold one of the item's rarest tokens, as many of these as may be missing and one
    more; only they propose documents, and each proposal is then counted out. So common tokens never meet all texts.
    """
    wanted = asked.select("token").distinct()
    postings = docs.select("doc_id", F.explode(token_set(F.col("text"))).alias("token")).join(wanted, "token", "left_semi")
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    own = Window.partitionBy("item_id")
    rare = asked.join(df, "token", "left").withColumn("n", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy(F.coalesce("df", F.lit(0)), "token")))
    need = F.ceil(F.lit(least) * F.col("n") - 1e-9)
    probes = rare.where(F.col("r") <= F.col("n") - need + 1).select("item_id", "token")
    proposed = probes.join(postings, "token").select("item_id", "doc_id").distinct()
    held = proposed.join(rare.select("item_id", "token", "n"), "item_id").join(postings, ["doc_id", "token"])
    counted = held.groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    return counted.where(F.col("shared") >= F.ceil(F.lit(least) * F.col("n") - 1e-9)).select("item_id", "doc_id", quantised(F.col("shared") / F.col("n")).alias("overlap"))


def grounding(questions: DataFrame, docs: DataFrame, least: float = 0.7) -> DataFrame:
    """Token-set overlap of whole questions with whole documents, ``least`` or more."""
    return covering(asked_tokens(questions), docs, least)


def mentions(names: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id: documents that hold all words of a name (item_id, text)."""
    asked = names.select("item_id", F.explode(token_set(F.col("text"))).alias("token"))
    return covering(asked, docs, 1.0).select("item_id", "doc_id")


def gate(rows: DataFrame, cues: list[tuple[str, str]], text: str = "text", otherwise: str = "answerable") -> DataFrame:
    """``rows`` with ``gate``: the first of ``cues`` (verdict, pattern) whose pattern the lower-cased text holds."""
    verdict = F.lit(otherwise)
    for name, pattern in reversed(cues):
        verdict = F.when(F.rlike(F.lower(F.col(text)), F.lit(pattern)), name).otherwise(verdict)
    return rows.withColumn("gate", verdict)
