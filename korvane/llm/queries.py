"""The registered queries of this subpackage: thin readings of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.llm import alignment, bpe, counts, licenses, lines, media, packing, simhash, spelling, suffixes, toxicity, vafile, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.audit(warc.replicas(_table(spark, sf_dir, "pages")), [F.col("page_id"), F.col("a")])
    return found.select("page_id", "offset", "length", "kind")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")).drop("ids")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vafile.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeats(_table(spark, sf_dir, "documents"))
    kept = F.lower(F.hex(F.when(F.col("kept").isNull(), F.col("sha")).otherwise(F.unhex(F.sha2("kept", 256)))))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", kept.alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (toxicity.fold_of() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=2)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(_table(spark, sf_dir, "documents")))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), digest=True)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(_table(spark, sf_dir, "documents"), least=6, every=199)
    return spelling.group_variants(words.where("n >= 5"), ratio=5)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.Alignment(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    return found.documents().drop("groups")


def op13_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.prefix_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_licenses": op3_licenses,
    "op4_topk": op4_topk,
    "op5_suffixes": op5_suffixes,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_media": op8_media,
    "op9_lines": op9_lines,
    "op10_bpe": op10_bpe,
    "op11_spelling": op11_spelling,
    "op12_alignment": op12_alignment,
    "op13_counts": op13_counts,
}
ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op9_lines": lines.ORACLE,
    "op4_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10""",
}
