"""Stored tables bound to the given ones: batches are merged in the shared folder, and the result is the table or its audit rows.

Each run writes tables of its own, which go when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.operators.scoring import validated
from korvane.plans import retrieval
from korvane.store.outbox import Outbox
from korvane.store.postings import PositionalIndex
from korvane.store.tables import DELETE, INSERT, UPSERT, Files, KeyedTable, shared_base

Query = Callable[[SparkSession, str], DataFrame]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared base, deleted at the end of the driver."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"

    def forget() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            Files(spark, path).delete("")

    atexit.register(forget)
    return path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """Line items as scores of a part by a line: handed in by year of shipping, withdrawn where returned, refused out of range."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("presenter"), F.col("l_linenumber").alias("judge"), F.array("l_quantity", F.col("l_linenumber").cast("double")).alias("scores"), "l_returnflag", "l_shipdate", "l_orderkey")
    good = validated(rows, "scores", 2, 1, 45).where("fault is null").withColumn("final_score", F.floor("final_score").cast("long"))
    table = KeyedTable(spark, folder(spark, "scores"), "presenter long, judge long, final_score long", ["presenter", "judge"])
    op = F.when(F.col("l_returnflag") == "R", DELETE).otherwise(UPSERT)
    for name, part in (("early", F.year("l_shipdate") < 1996), ("middle", F.year("l_shipdate").between(1996, 1998)), ("late", F.year("l_shipdate") > 1998)):
        table.merge(good.where(part), name, op, order=F.struct("l_shipdate", "l_orderkey"))
    return table


def pages(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """Pages taken in by content hash, then again with every page of a second visit whose text has grown; pages without any host are left out."""
    table = KeyedTable(spark, folder(spark, "pages"), "url string, page_id long, digest string", ["url"])
    first = read(spark, sf_dir, "pages").select("url", "page_id", F.sha2("html", 256).alias("digest"))
    table.merge(first, "visit-1", order=F.col("page_id"))
    grown = F.when(F.length("html") > 3000, F.concat("html", F.lit("<!-- more -->"))).otherwise(F.col("html"))
    table.merge(read(spark, sf_dir, "pages").select("url", "page_id", F.sha2(grown, 256).alias("digest")), "visit-2", order=F.col("page_id"))
    return table


def nodes(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """Nodes from two feeds: suppliers as they are, then customers of the same number and nation, whose missing attributes keep what is stored."""
    table = KeyedTable(spark, folder(spark, "nodes"), "slug string, name string, nation long, balance double, titles array<string>", ["slug"])
    one = read(spark, sf_dir, "supplier").select(F.concat(F.lit("n/"), "s_suppkey").alias("slug"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit(None).alias("balance"), F.array(F.lit("supplier")).alias("titles"))
    table.merge(one, "suppliers")
    two = read(spark, sf_dir, "customer").select(F.concat(F.lit("n/"), "c_custkey").alias("slug"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"), F.lit(None).cast("long").alias("nation"), F.col("c_acctbal").alias("balance"), F.array(F.lit("customer")).alias("titles"))
    both = F.array_distinct(F.concat(F.coalesce("old.titles", F.array().cast("array<string>")), "new.titles"))
    table.merge(two, "customers", keep_nulls=True, set_values={"titles": both})
    return table


def outbox(spark: SparkSession, sf_dir: str) -> Outbox:
    """Orders as requests, twice; a tick at a day; line items as the outcomes of deliveries, by year of shipping."""
    box = Outbox(spark, folder(spark, "outbox"))
    orders = read(spark, sf_dir, "orders")
    null: Column = F.lit(None)
    requests = orders.select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), null.cast("string").alias("request_key"), F.col("o_custkey").alias("org"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("content"), F.col("o_orderdate").alias("scheduled_for"), null.cast("timestamp").alias("delete_at"))
    box.enqueue(requests, "in-1")
    box.enqueue(requests.withColumn("content", F.lit("changed")), "in-2")
    box.tick(F.lit("1998-06-01").cast("timestamp"), "tick")
    told = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("orders:"), "l_orderkey").alias("key"), F.concat_ws("/", "l_linenumber", "l_suppkey").alias("platform"), F.lit("m").alias("message"), (F.col("l_returnflag") == "A").alias("success"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("error"), F.col("l_shipdate").alias("at"))
    for name, part in (("early", F.year("at") < 1998), ("late", F.year("at") >= 1998)):
        box.settle(told.where(part), name)
    return box


def index(spark: SparkSession, sf_dir: str) -> PositionalIndex:
    """All documents, in three steps: without a source, then that source and new texts of a language, then without the long ones of another."""
    out, docs = PositionalIndex(spark, folder(spark, "index")), read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    out.update(docs.where("source <> 'src3'"), "base")
    changed = docs.where("source = 'src3' or lang = 'fr'").withColumn("text", F.when(F.col("lang") == "fr", F.concat(F.lit("again "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    out.update(changed, "more", docs.where("lang = 'es' and n_chars > 3000 and source <> 'src3'"))
    return out


def whole_index(spark: SparkSession, sf_dir: str) -> PositionalIndex:
    out = PositionalIndex(spark, folder(spark, "index"))
    out.update(read(spark, sf_dir, "documents"), "all")
    return out


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = index(spark, sf_dir).rows().where("token <> ''")
    places = F.aggregate("held", F.lit(0).cast("long"), lambda n, x: n + F.size(x["at"]))
    return held.groupBy("token").agg(F.sum(F.size("held")).alias("docs"), F.sum(places).alias("places"))


QUERIES: dict[str, Query] = {
    "e16_score_table": lambda s, d: scores(s, d).read(),
    "e16_score_audit": lambda s, d: scores(s, d).audit().drop("batch"),
    "e16_score_history": lambda s, d: scores(s, d).history(),
    "e04_page_table": lambda s, d: pages(s, d).audit().select("url", "page_id", "action", "version"),
    "e05_node_table": lambda s, d: nodes(s, d).read().withColumn("titles", F.array_join("titles", "|")),
    "r09_delivery_table": lambda s, d: outbox(s, d).posts.read().select("key", "content", "status", "sent_at"),
    "s16_index_upkeep": token_counts,
    "x09_phrases": lambda s, d: whole_index(s, d).phrases(read(s, d, "benchmark")).select("item_id", "doc_id"),
    "t04_stored_index": lambda s, d: whole_index(s, d).bm25(read(s, d, "benchmark")),
    "u11_outbox": lambda s, d: outbox(s, d).posts.audit().where(F.col("action") == INSERT).select("key", "content", "version"),
}

_SCORES = """s AS (SELECT l_partkey AS presenter, l_linenumber AS judge, CAST(floor((l_quantity + l_linenumber) / 2) AS BIGINT) AS final_score, l_returnflag = 'R' AS gone, l_shipdate, l_orderkey,
  CASE WHEN year(l_shipdate) < 1996 THEN 1 WHEN year(l_shipdate) <= 1998 THEN 2 ELSE 3 END AS version FROM lineitem WHERE l_quantity BETWEEN 1 AND 45 AND l_linenumber BETWEEN 1 AND 45),
last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY presenter, judge, version ORDER BY l_shipdate DESC, l_orderkey DESC, gone DESC, final_score DESC) = 1),
steps AS (SELECT *, lag(gone) OVER w AS was_gone, lag(final_score) OVER w AS was FROM last WINDOW w AS (PARTITION BY presenter, judge ORDER BY version)),
audit AS (SELECT presenter, judge, CASE WHEN gone THEN was ELSE final_score END AS final_score, version,
  CASE WHEN coalesce(was_gone, true) THEN CASE WHEN NOT gone THEN 'insert' END WHEN gone THEN 'delete' WHEN was <> final_score THEN 'update' END AS action FROM steps)"""

ORACLES: dict[str, str] = {
    "e16_score_table": f"WITH {_SCORES} SELECT presenter, judge, final_score FROM last WHERE NOT gone QUALIFY row_number() OVER (PARTITION BY presenter, judge ORDER BY version DESC) = 1 AND version = (SELECT max(version) FROM last l WHERE l.presenter = last.presenter AND l.judge = last.judge)",
    "e16_score_audit": f"WITH {_SCORES} SELECT presenter, judge, final_score, action, CAST(version AS BIGINT) AS version FROM audit WHERE action IS NOT NULL",
    "e16_score_history": f"""WITH {_SCORES} SELECT presenter, judge, final_score, CAST(version AS BIGINT) AS since, CAST("until" AS BIGINT) AS "until"
FROM (SELECT *, lead(version) OVER (PARTITION BY presenter, judge ORDER BY version) AS "until" FROM audit WHERE action IS NOT NULL) WHERE action <> 'delete'""",
    "e04_page_table": """WITH p AS (SELECT url, page_id, length(html) > 3000 AS grown FROM pages WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)
SELECT url, page_id, 'insert' AS action, CAST(1 AS BIGINT) AS version FROM p UNION ALL SELECT url, page_id, 'update', 2 FROM p WHERE grown""",
    "e05_node_table": """SELECT 'n/' || coalesce(s_suppkey, c_custkey) AS slug, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, s_name) AS name, CAST(s_nationkey AS BIGINT) AS nation, c_acctbal AS balance,
  concat_ws('|', CASE WHEN s_suppkey IS NOT NULL THEN 'supplier' END, CASE WHEN c_custkey IS NOT NULL THEN 'customer' END) AS titles FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey""",
    "r09_delivery_table": """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderdate <= TIMESTAMP '1998-06-01' AS due FROM orders),
t AS (SELECT l_orderkey, year(l_shipdate) < 1998 AS early, bool_or(l_returnflag = 'A') AS ok, max(l_shipdate) AS last FROM lineitem GROUP BY l_orderkey, year(l_shipdate) < 1998),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY early DESC) = 1)
SELECT 'orders:' || o_orderkey AS key, o_orderstatus AS content, CASE WHEN NOT due THEN 'scheduled' WHEN f.l_orderkey IS NULL THEN 'sending' WHEN ok THEN 'sent' ELSE 'failed' END AS status,
  CASE WHEN due THEN last END AS sent_at FROM o LEFT JOIN f ON l_orderkey = o_orderkey""",
    "s16_index_upkeep": """WITH d AS (SELECT CASE WHEN lang = 'fr' THEN 'again ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE coalesce(NOT (lang = 'es' AND n_chars > 3000 AND source <> 'src3'), true)),
t AS (SELECT row_number() OVER () AS i, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}') AS ts FROM d), e AS (SELECT i, unnest(ts) AS token FROM t)
SELECT token, count(DISTINCT i) AS docs, count(*) AS places FROM e GROUP BY token""",
    "x09_phrases": """WITH p AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]{2,}'), ' ') || ' ' AS s FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) > 0),
d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]{2,}'), ' ') || ' ' AS s FROM documents)
SELECT item_id, doc_id FROM p JOIN d ON contains(d.s, p.s)""",
    "t04_stored_index": retrieval.ORACLES["t04_bm25"],
    "u11_outbox": "SELECT 'orders:' || o_orderkey AS key, o_orderstatus AS content, CAST(1 AS BIGINT) AS version FROM orders",
}
