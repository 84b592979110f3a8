"""The retrieval operators bound to the given tables, each with DuckDB SQL written for itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.operators import retrieval as r

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, text and embedding: a benchmark item is asked by its text and by the vector of its number."""
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return _read(spark, sf_dir, "benchmark").join(vectors, "item_id", "left")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "embeddings"), questions(spark, sf_dir)


def allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of active documents (no label of poor quality) of the wanted languages, without the excluded sources."""
    poor = _read(spark, sf_dir, "labels").where("quality = 0")
    return _read(spark, sf_dir, "documents").where("lang in ('en', 'de') and source not in ('src1', 'src2')").join(poor, "doc_id", "left_anti").select("doc_id")


def hybrid(spark: SparkSession, sf_dir: str, k: int = r.ANSWERS) -> DataFrame:
    return r.hybrid(*_tables(spark, sf_dir), k=k, allowed=allowed(spark, sf_dir))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("entity"))


def diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, asked = _tables(spark, sf_dir)
    return r.diversified(r.bm25(docs, asked), entities(spark, sf_dir))


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = _read(spark, sf_dir, "documents").groupBy(F.col("source").alias("entity")).agg(F.min("doc_id").alias("profile_id"))
    return r.expanded(diversified(spark, sf_dir), profiles)


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors, asked = _tables(spark, sf_dir)
    ranked = r.bm25(docs, asked)
    prior = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.when(F.min("quality") == 0, 0.85).otherwise(1.0).alias("prior"))
    return r.reranked(ranked, r.pair_scores(ranked.where(F.col("place") <= r.RERANK), vectors, asked), prior)


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vectors, asked = _tables(spark, sf_dir)
    return r.best_children(vectors, asked, vectors.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("parent")))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tag, vec_id, embedding: the first three words of the documents of one source."""
    docs = _read(spark, sf_dir, "documents").where("source = 'src7'").select(F.col("doc_id").alias("vec_id"), F.array_join(F.slice(r.tokens(F.col("text")), 1, 3), " ").alias("tag"))
    return docs.where("tag <> ''").join(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")


QUERIES: dict[str, Query] = {
    "t01_knn": lambda s, d: r.nearest(*_tables(s, d)[1:]),
    "t02_filtered_knn": lambda s, d: r.nearest(_read(s, d, "embeddings").where("label = 3"), questions(s, d)),
    "t03_over_fetch": lambda s, d: children(s, d).select("item_id", "fetched").distinct(),
    "t04_bm25": lambda s, d: r.bm25(_read(s, d, "documents"), _read(s, d, "benchmark")),
    "x10_okapi": lambda s, d: r.bm25(_read(s, d, "documents"), _read(s, d, "benchmark"), okapi=True),
    "x11_similarity": lambda s, d: r.nearest(*_tables(s, d)[1:], k=5).select("item_id", "doc_id", r.quantised(r.similarity(F.col("score"))).alias("cosine")),
    "w05_hybrid": hybrid,
    "w06_normalised": lambda s, d: r.normalised(hybrid(s, d)),
    "w07_reranked": reranked,
    "w08_diversify": diversified,
    "w09_parent_expansion": expanded,
    "w10_best_children": lambda s, d: children(s, d).drop("fetched"),
    "n10_exemplars": lambda s, d: r.exemplar_decision(*_tables(s, d)[1:]),
    "n11_nearest_description": lambda s, d: r.nearest_description(_read(s, d, "embeddings").where("vec_id >= 100 and vec_id < 200"), questions(s, d)),
    "n13_candidate_tags": lambda s, d: r.candidate_tags(tags(s, d), questions(s, d)),
    "z19_target_rank": lambda s, d: r.target_rank(*_tables(s, d)[1:], _read(s, d, "benchmark").select("item_id", (F.col("item_id") + 1).alias("target_id"))),
}

_TS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]', ' ', 'g'), ' '), lambda t: length(t) > 1)"
_STOP = ", ".join(f"'{w}'" for w in r.STOP)
_ASK = f"""
asked0 AS (SELECT item_id, list_distinct({_TS.format('text')}) AS ts FROM benchmark),
ask AS (SELECT item_id, unnest(CASE WHEN len(list_filter(ts, lambda t: t NOT IN ({_STOP}))) > 0
  THEN list_filter(ts, lambda t: t NOT IN ({_STOP})) ELSE ts END) AS token FROM asked0)"""
_KEYWORD = f"""{_ASK},
d AS (SELECT doc_id, {_TS.format('text')} AS ts FROM documents),
sz AS (SELECT count(*) AS total, avg(len(ts)) AS mean FROM d),
post AS (SELECT token, doc_id, n, count(*) AS tf FROM (SELECT doc_id, len(ts) + 0 AS n, unnest(ts) AS token FROM d) x GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token)"""


def _bm25(k1: float, idf: str, among: str = "") -> str:
    return f"""kw AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS place FROM (
  SELECT ask.item_id, post.doc_id, floor(sum({idf} * tf * {k1 + 1} / (tf + {k1} * (0.25 + 0.75 * n / mean))) * 1e6 + 0.5) / 1e6 AS score
  FROM ask JOIN df USING (token) JOIN post USING (token) CROSS JOIN sz {among} GROUP BY ask.item_id, post.doc_id)) WHERE place <= 40)"""


_RAW = "ln((total - df + 0.5) / (df + 0.5))"
_PLAIN = _bm25(1.2, f"greatest({_RAW}, 1e-6)")
_AMONG = """fine AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source NOT IN ('src1', 'src2')
  AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))"""
_V = "list_transform({}, lambda x: CAST(x AS DOUBLE))"
_PAIRS = f"""
qv AS (SELECT b.item_id, {_V.format('e.embedding')} AS q FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
pv AS (SELECT vec_id AS doc_id, label, {_V.format('embedding')} AS v FROM embeddings),
pr AS (SELECT item_id, doc_id, label, list_sum(list_transform(list_zip(v, q), lambda p: p[1] * p[2])) AS dot,
  sqrt(list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS far,
  sqrt(list_sum(list_transform(v, lambda x: x * x)) * list_sum(list_transform(q, lambda x: x * x))) AS lengths FROM qv CROSS JOIN pv)"""


def _near(where: str = "true", k: int = 40) -> str:
    return f"""nn AS (SELECT * FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id) AS INTEGER) AS place
  FROM (SELECT item_id, doc_id, floor(far * 1e6 + 0.5) / 1e6 AS score FROM pr WHERE {where})) WHERE place <= {k})"""


_FUSED = """f AS (SELECT coalesce(nn.item_id, kw.item_id) AS item_id, coalesce(nn.doc_id, kw.doc_id) AS doc_id,
  floor((coalesce(1.0::DOUBLE / (60 + nn.place), 0) + coalesce(1.0::DOUBLE / (60 + kw.place), 0)) * 1e9 + 0.5) / 1e9 AS score,
  CASE WHEN nn.place IS NULL THEN 'keyword' WHEN kw.place IS NULL THEN 'semantic' ELSE 'hybrid' END AS source
  FROM nn FULL OUTER JOIN kw ON nn.item_id = kw.item_id AND nn.doc_id = kw.doc_id),
hy AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS place FROM f) WHERE place <= 5)"""
_HYBRID = f"WITH {_KEYWORD}, {_AMONG}, {_bm25(1.2, f'greatest({_RAW}, 1e-6)', 'WHERE post.doc_id IN (SELECT doc_id FROM fine)')}, {_PAIRS}, {_near('doc_id IN (SELECT doc_id FROM fine)')}, {_FUSED}"
_TURNS = f"""WITH {_KEYWORD}, {_PLAIN},
e AS (SELECT item_id, kw.doc_id, source AS entity, row_number() OVER (PARTITION BY item_id, source ORDER BY place) AS turn, min(place) OVER (PARTITION BY item_id, source) AS opens
  FROM kw JOIN documents USING (doc_id)),
dv AS (SELECT item_id, doc_id, entity, slot FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY turn, opens) AS INTEGER) AS slot FROM e) WHERE slot <= 10)"""
_CHILDREN = f"""WITH RECURSIVE {_PAIRS}, {_near(k=4096)},
op AS (SELECT item_id, label AS parent, min(place) AS place, arg_min(score, place) AS score FROM nn JOIN embeddings e ON e.vec_id = nn.doc_id GROUP BY ALL),
tries AS (SELECT DISTINCT item_id, CAST(40 AS BIGINT) AS k FROM nn
  UNION ALL SELECT item_id, least(4096, 2 * k) FROM tries t WHERE k < 4096 AND (SELECT count(*) FROM op WHERE op.item_id = t.item_id AND op.place <= k) < 5),
stop AS (SELECT item_id, max(k) AS fetched FROM tries GROUP BY item_id),
ch AS (SELECT item_id, parent, score, slot, CAST(fetched AS INTEGER) AS fetched FROM (SELECT op.item_id, parent, score, fetched,
  CAST(row_number() OVER (PARTITION BY op.item_id ORDER BY score, parent) AS INTEGER) AS slot FROM op JOIN stop USING (item_id) WHERE place <= fetched) WHERE slot <= 5)"""

ORACLES: dict[str, str] = {
    "t01_knn": f"WITH {_PAIRS}, {_near()} SELECT * FROM nn",
    "t02_filtered_knn": f"WITH {_PAIRS}, {_near('label = 3')} SELECT * FROM nn",
    "t03_over_fetch": f"{_CHILDREN} SELECT DISTINCT item_id, fetched FROM ch",
    "t04_bm25": f"WITH {_KEYWORD}, {_PLAIN} SELECT * FROM kw",
    "x10_okapi": f"""WITH {_KEYWORD}, typical AS (SELECT avg({_RAW}) AS typical FROM df CROSS JOIN sz WHERE token IN (SELECT token FROM ask)),
{_bm25(1.5, f'(CASE WHEN {_RAW} < 0 THEN 0.25 * typical ELSE {_RAW} END)', 'CROSS JOIN typical')} SELECT * FROM kw""",
    "x11_similarity": f"WITH {_PAIRS}, {_near(k=5)} SELECT item_id, doc_id, floor(greatest(0, 1 - score * score / 2) * 1e6 + 0.5) / 1e6 AS cosine FROM nn",
    "w05_hybrid": f"{_HYBRID} SELECT * FROM hy",
    "w06_normalised": f"""{_HYBRID} SELECT item_id, doc_id, floor((CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
  ELSE 0.40::DOUBLE + 0.55::DOUBLE * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END) * 1e6 + 0.5) / 1e6 AS score FROM hy WINDOW w AS (PARTITION BY item_id)""",
    "w07_reranked": f"""WITH {_KEYWORD}, {_PLAIN}, {_PAIRS},
a AS (SELECT kw.item_id, kw.doc_id, place, row_number() OVER (PARTITION BY kw.item_id ORDER BY floor(dot * 1e6 + 0.5) / 1e6 DESC NULLS LAST, kw.doc_id) AS again
  FROM kw LEFT JOIN pr ON pr.item_id = kw.item_id AND pr.doc_id = kw.doc_id WHERE place <= 20),
f AS (SELECT item_id, a.doc_id, place, floor((1.0::DOUBLE / (60 + place) + 1.0::DOUBLE / (10 + again)) * CASE WHEN p.q = 0 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END * 1e9 + 0.5) / 1e9 AS fresh
  FROM a LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id) p ON p.doc_id = a.doc_id)
SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY fresh DESC, place) AS INTEGER) AS slot FROM f UNION ALL SELECT item_id, doc_id, place FROM kw WHERE place > 20""",
    "w08_diversify": f"{_TURNS} SELECT * FROM dv",
    "w09_parent_expansion": f"""{_TURNS}, profile AS (SELECT source AS entity, min(doc_id) AS profile_id FROM documents GROUP BY source),
firsts AS (SELECT item_id, entity, min(slot) AS slot FROM dv GROUP BY ALL),
more AS (SELECT f.item_id, p.profile_id AS doc_id, f.slot, true AS expanded FROM firsts f JOIN profile p USING (entity)
  WHERE NOT EXISTS (SELECT 1 FROM dv WHERE dv.item_id = f.item_id AND dv.doc_id = p.profile_id)),
u AS (SELECT item_id, doc_id, slot, false AS expanded FROM dv UNION ALL SELECT * FROM more)
SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY slot, expanded DESC, doc_id) AS INTEGER) AS slot, expanded FROM u""",
    "w10_best_children": f"{_CHILDREN} SELECT item_id, parent, score, slot FROM ch",
    "n10_exemplars": f"""WITH {_PAIRS}, e8 AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 8),
c AS (SELECT item_id, label, max(floor(dot * 1e6 + 0.5) / 1e6) AS score FROM pr WHERE doc_id IN (SELECT vec_id FROM e8) GROUP BY ALL),
g AS (SELECT *, row_number() OVER w AS r, floor((score - lead(score) OVER w) * 1e6 + 0.5) / 1e6 AS margin FROM c WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, label))
SELECT item_id, label, score, margin, CASE WHEN score < 0.3 OR margin < 0.02 THEN 'clarify' ELSE 'route' END AS decision FROM g WHERE r = 1""",
    "n11_nearest_description": f"""WITH {_PAIRS} SELECT item_id, CASE WHEN score >= 0.6 THEN label END AS label, score FROM (
  SELECT item_id, label, floor(dot / lengths * 1e6 + 0.5) / 1e6 AS score, row_number() OVER (PARTITION BY item_id ORDER BY floor(dot / lengths * 1e6 + 0.5) / 1e6 DESC, doc_id) AS r
  FROM pr WHERE doc_id >= 100 AND doc_id < 200) WHERE r = 1""",
    "n13_candidate_tags": f"""WITH {_ASK}, {_PAIRS}, tg AS (SELECT doc_id, array_to_string({_TS.format('text')}[1:3], ' ') AS tag FROM documents WHERE source = 'src7' AND doc_id IN (SELECT vec_id FROM embeddings)),
tt AS (SELECT * FROM tg WHERE tag <> ''),
near AS (SELECT item_id, tag FROM (SELECT item_id, tag, row_number() OVER (PARTITION BY item_id ORDER BY floor(dot / lengths * 1e6 + 0.5) / 1e6 DESC, pr.doc_id) AS r FROM pr JOIN tt ON tt.doc_id = pr.doc_id) WHERE r <= 10),
words AS (SELECT tag, unnest(string_split(tag, ' ')) AS token FROM tt)
SELECT item_id, tag FROM near UNION SELECT item_id, tag FROM ask JOIN words USING (token) WHERE length(token) > 2""",
    "z19_target_rank": f"""WITH {_PAIRS}, s AS (SELECT item_id, doc_id, floor(dot * 1e6 + 0.5) / 1e6 AS score FROM pr), g AS (SELECT item_id, score AS goal FROM s WHERE doc_id = item_id + 1)
SELECT item_id, 1 + count(*) FILTER (WHERE score > goal) AS target_rank FROM s JOIN g USING (item_id) GROUP BY item_id""",
}
