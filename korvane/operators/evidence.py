"""Whether a fact is held anywhere: evidence of several probes in one union, judged span by span, and bands over the best score.

Facts are (fact_id, text), items (doc_id, text), nodes (node_id, text: names and attributes). Evidence is (fact_id, probe,
kind, ref): one row for each probe and place, written once in the shared folder. Phrases propose texts by their rarest pair of neighbouring words and are then
held against the texts proposed; no fact meets all texts, and texts stay where they lie while the places proposed are few enough to be sent to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvane.functions.matching import token_set
from korvane.operators.lineage import cut
from korvane.operators.retrieval import STOP, _beside, bm25, nearest, quantised, tokens

#: Runs of two and more capitalised words; runs of 13 and more letters, digits, hyphens and spaces.
NAMES, RUNS = "([A-Z][a-z]+(?: [A-Z][a-z]+)+)", "([A-Za-z0-9][A-Za-z0-9 -]{12,})"
#: Support that makes a fact present, and support that leaves it open.
HIGH, LOW = 0.9, 0.5


def _pairs(words: Column) -> Column:
    """Hashes of neighbouring words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def _singles(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _found(facts: DataFrame, texts: DataFrame, pattern: str, probe: str, kind: str) -> DataFrame:
    """Texts (ref, text) that hold, word after word, a run of the pattern in a fact; words of one character do not count."""
    runs = facts.where("fact_id is not null").select("fact_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(1)))).alias("run"))
    said = cut(runs.select("fact_id", F.array_join(tokens(F.col("run")), " ").alias("said")).where("said <> ''").distinct())
    own = F.split("said", " ")
    keys = cut(said.select("said").distinct().select("said", F.explode(F.array_distinct(F.when(F.size(own) > 1, _pairs(own)).otherwise(_singles(own)))).alias("key")))
    ts = tokens(F.col("text"))
    alone = said.where(~F.contains("said", F.lit(" "))).limit(1).count()  # only runs of one word are looked for by single words
    held_keys = F.array_distinct(F.concat(_pairs(F.col("ts")), _singles(F.col("ts"))) if alone else _pairs(F.col("ts")))
    postings = cut(texts.select("ref", ts.alias("ts")).select("ref", F.explode(held_keys).alias("key")).join(_beside(keys.select("key").distinct()), "key", "left_semi"))
    df = postings.groupBy("key").agg(F.count("*").alias("df"))
    # a text that holds the run holds its rarest key; keys that no text has leave no candidates, those of equal hash are told apart below
    rare = keys.join(df, "key", "left").groupBy("said").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("r")).select("said", "r.key")
    near = cut(postings.join(_beside(rare), "key").select("said", "ref").distinct())
    flat = texts.join(_beside(near.select("ref").distinct()), "ref", "left_semi").select("ref", F.concat(F.lit(" "), F.array_join(ts, " "), F.lit(" ")).alias("flat"))
    held = near.join(flat, "ref").where(F.contains("flat", F.concat(F.lit(" "), "said", F.lit(" ")))).select("said", "ref").distinct()
    return said.join(held, "said").select("fact_id", F.lit(probe).alias("probe"), F.lit(kind).alias("kind"), "ref").distinct()


def _ranked(found: DataFrame, probe: str) -> DataFrame:
    return found.select(F.col("item_id").alias("fact_id"), F.lit(probe).alias("probe"), F.lit("item").alias("kind"), F.col("doc_id").alias("ref")).distinct()


def gathered(facts: DataFrame, items: DataFrame, nodes: DataFrame | None = None, vectors: DataFrame | None = None, questions: DataFrame | None = None, words: int = 20, near: int = 100) -> DataFrame:
    """fact_id, probe, kind, ref: names in nodes, runs of words in items and nodes, the ``words`` best items by keyword, the ``near`` closest vectors.

    Vectors are (vec_id, embedding) of items, questions (item_id, embedding) of facts; either probe is left out where its tables are.
    """
    rows = items.select(F.col("doc_id").alias("ref"), "text").where("ref is not null")
    out = _found(facts, rows, RUNS, "phrase", "item")
    out = out.unionByName(_ranked(bm25(items.select("doc_id", "text"), facts.select(F.col("fact_id").alias("item_id"), "text"), words), "keyword"))
    if nodes is not None:
        held = nodes.select(F.col("node_id").alias("ref"), "text").where("ref is not null")
        out = out.unionByName(_found(facts, held, NAMES, "name", "node")).unionByName(_found(facts, held, RUNS, "phrase", "node"))
    if vectors is not None and questions is not None:
        out = out.unionByName(_ranked(nearest(vectors, questions, near), "vector"))
    return cut(out)


def support(fact: Column, span: Column) -> Column:
    """The share of a fact's distinct content words that a span holds (arrays of words); 0 of a fact without any."""
    return F.when(F.size(fact) > 0, F.size(F.array_intersect(fact, span)) / F.size(fact)).otherwise(0.0)


def judged(evidence: DataFrame, facts: DataFrame, spans: DataFrame, judge: Callable[[Column, Column], Column] = support) -> DataFrame:
    """The evidence with a score: the judge's of the fact's content words and the words of the span (kind, ref, text). Places met by several probes are judged once, a place of several texts by each."""
    said = facts.select("fact_id", F.filter(token_set(F.col("text")), lambda t: ~t.isin(*STOP)).alias("_fact")).dropDuplicates(["fact_id"])
    pairs = evidence.groupBy("fact_id", "kind", "ref").agg(F.collect_set("probe").alias("probes"))  # at most one entry a probe
    held = spans.join(_beside(evidence.select("kind", "ref").distinct()), ["kind", "ref"], "left_semi").select("kind", "ref", token_set(F.col("text")).alias("_span"))
    told = pairs.join(said, "fact_id").join(held, ["kind", "ref"])
    return told.select("fact_id", "kind", "ref", quantised(judge(F.col("_fact"), F.col("_span"))).alias("score"), F.explode("probes").alias("probe"))


def presence(facts: DataFrame, scored: DataFrame, high: float = HIGH, low: float = LOW) -> DataFrame:
    """fact_id, present, low_conf, probes (those of the evidence that counts, sorted), n_evidence, max_score.

    A fact is present where a span reaches ``high``; in the band down to ``low`` it is not, but stays open with its evidence
    kept; under it nothing counts. Facts without evidence are kept with score 0; null scores count as 0; ids are distinct.
    """
    s = F.coalesce("score", F.lit(0.0))
    of = lambda least, x: F.when(s >= least, x)
    place = F.struct("kind", "ref")
    told = scored.groupBy("fact_id").agg(
        F.max(s).alias("max_score"), *(F.array_sort(F.collect_set(of(t, F.col("probe")))).alias(f"_p{i}") for i, t in enumerate((high, low))), *(F.count_distinct(of(t, place)).alias(f"_n{i}") for i, t in enumerate((high, low)))
    )
    reached = F.col("max_score") >= high
    kept = told.select("fact_id", "max_score", F.when(reached, F.col("_p0")).otherwise(F.col("_p1")).alias("probes"), F.when(reached, F.col("_n0")).otherwise(F.col("_n1")).alias("n_evidence"))
    out = facts.select("fact_id").where("fact_id is not null").distinct().join(kept, "fact_id", "left")
    m = F.coalesce("max_score", F.lit(0.0))
    return out.select("fact_id", (m >= high).alias("present"), ((m >= low) & (m < high)).alias("low_conf"), F.array_join(F.coalesce("probes", F.array()), ",").alias("probes"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), m.alias("max_score"))
