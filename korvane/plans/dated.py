"""Schedules, dates, weights of age and walks within a key, bound to the given tables, each with DuckDB SQL of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.functions import schedules
from korvane.operators import histories
from korvane.operators.retrieval import quantised
from korvane.plans.bound import read

Query = Callable[[SparkSession, str], DataFrame]
c = F.col
_KINDS = {"1-URGENT": "daily", "2-HIGH": "weekly", "3-MEDIUM": "monthly", "4-NOT SPECIFIED": "once"}


def recurrences(s: SparkSession, d: str) -> DataFrame:
    """Orders as schedules: urgency is how often, the month how many steps, the day the hour (some no clock has), the state the weekdays."""
    o, day = read(s, d, "orders"), c("o_orderdate")
    freq = F.coalesce(*(F.when(c("o_orderpriority") == k, v) for k, v in _KINDS.items()))
    days = F.when(c("o_orderstatus") == "F", F.array(F.lit(0), F.lit(2), F.lit(4))).when(c("o_orderstatus") == "P", F.array(F.lit(6)))
    end = F.when(c("o_totalprice") < 100000, F.date_format(F.date_add(day, 20), "yyyy-MM-dd"))
    told = schedules.next_occurrence(freq, F.month(day), F.concat(F.dayofmonth(day).cast("string"), F.lit(":30")), days, end, day)
    return o.select("o_orderkey", told.cast("string").alias("next"))


def event_times(s: SparkSession, d: str) -> DataFrame:
    """Lines as events: a whole hour, a clock with minutes, or none, by their flag."""
    q = F.least(F.floor("l_quantity"), F.lit(59)).cast("string")
    text = F.when(c("l_returnflag") == "R", F.concat(F.lit("from "), c("l_linenumber").cast("string"), F.lit(" PM on"))).when(c("l_returnflag") == "A", F.concat(F.lit("11"), c("l_linenumber").cast("string"), F.lit(":"), F.lpad(q, 2, "0"), F.when(c("l_linestatus") == "F", " pm").otherwise("")))
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", schedules.event_time(F.date_format("l_shipdate", "yyyy-M-d"), F.coalesce(text, F.lit("TBD"))).cast("string").alias("at"))


def priors(s: SparkSession, d: str) -> DataFrame:
    """Lines as rows of a kind by their flags, published when shipped, over ten days after that; untaxed ones have no date."""
    kind = F.when((c("l_returnflag") == "R") & (c("l_linestatus") == "F"), "news").when(c("l_returnflag") == "R", "event_info").when(c("l_returnflag") == "A", "event").when(c("l_linestatus") == "F", "webpage").otherwise("policy")
    told = F.when(c("l_tax") > 0, F.date_format("l_shipdate", "yyyy-MM-dd"))
    over = F.when(c("l_discount") > 0, F.date_format(F.date_add("l_shipdate", 10), "yyyy-MM-dd'T'HH:mm:ss"))
    weight = schedules.prior(kind, told, told, over, F.lit("1998-01-01 12:00:00").cast("timestamp"))
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", quantised(weight).alias("weight"))


def dates(s: SparkSession, d: str) -> DataFrame:
    """Orders as pages whose markup tells their dates: urgent ones in a meta element, finished ones as an event in JSON, all in a time element; each within a whole page."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    meta = F.when(c("o_orderpriority") == "1-URGENT", F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T08:00">'))).otherwise("")
    script = F.when(c("o_orderstatus") == "F", F.concat(F.lit('<script type="application/ld+json">[{"@type": "Event", "startDate": "'), day, F.lit('"}, {"@type": "Article", "datePublished": "p'), day, F.lit('", "dateModified": "'), day, F.lit('Z"}]</script>'))).otherwise("<script>var x = '<p>';</script>")
    html = F.concat(F.lit("<html><head>"), meta, script, F.lit("</head><body><!-- <time datetime='never'> --><time class=\"t\" datetime='t"), day, F.lit("'>then</time></body></html>"))
    return read(s, d, "orders").withColumn("x", schedules.page_dates(html)).select("o_orderkey", "x.*")


def papers(s: SparkSession, d: str) -> DataFrame:
    """Lines as papers of their supplier: the part is the cluster, unless untaxed."""
    p = read(s, d, "lineitem").select(c("l_suppkey").alias("person"), F.when(c("l_tax") > 0, c("l_partkey")).alias("paper"), c("l_orderkey").cast("string").alias("title"), F.year("l_shipdate").alias("year"), c("l_quantity").cast("int").alias("cited"))
    return histories.highlights(p, 1997).select("person", "list", "place", "cited", "title")


def chains(s: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as versions of the first, by day of order; the finished ones of high price are active."""
    o = read(s, d, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    rows = o.join(first, "o_custkey").select(c("o_orderkey").alias("id"), F.when(c("first") < c("o_orderkey"), c("first")).alias("root_id"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("version"), ((c("o_orderstatus") == "F") & (c("o_totalprice") > 200000)).alias("active"))
    return histories.versions(rows)


def walks(s: SparkSession, d: str) -> DataFrame:
    """Lines of an order as goals, returned ones for the away team."""
    goals = read(s, d, "lineitem").select(c("l_orderkey").alias("match"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"), c("l_suppkey").alias("supplier"), c("l_extendedprice").alias("price"), c("l_returnflag").alias("team"), F.lit("R").alias("away"))
    return histories.running_scores(goals, ["line", "part", "supplier", "price"]).select("match", "line", "part", "home_score", "away_score")


QUERIES: dict[str, Query] = {
    "d02_next_occurrence": recurrences,
    "d03_event_times": event_times,
    "x12_priors": priors,
    "x17_compared": lambda s, d: read(s, d, "documents").select("doc_id", F.sha2(schedules.mended(c("text")), 256).alias("mended"), F.sha2(schedules.compared(c("text")), 256).alias("compared")),
    "x22_structured_dates": dates,
    "w17_paper_lists": papers,
    "w19_versions": chains,
    "w23_running_scores": walks,
}

_T = "CAST({} AS VARCHAR)"
ORACLES: dict[str, str] = {
    "d02_next_occurrence": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderpriority AS p, CASE o_orderstatus WHEN 'F' THEN [0, 2, 4] WHEN 'P' THEN [6] ELSE [isodow(o_orderdate) - 1] END AS ws, o_totalprice FROM orders),
n AS (SELECT *, CASE p WHEN '2-HIGH' THEN (SELECT min(d + CAST(k AS INTEGER)) FROM range(1, 8) r(k) WHERE list_contains(ws, isodow(d + CAST(k AS INTEGER)) - 1)) WHEN '3-MEDIUM' THEN CAST(d + to_months(CAST(month(d) AS INTEGER)) AS DATE) WHEN '4-NOT SPECIFIED' THEN NULL ELSE d + CAST(month(d) AS INTEGER) END AS nx FROM o)
SELECT o_orderkey, CASE WHEN day(d) < 24 AND NOT (o_totalprice < 100000 AND nx > d + 20) THEN strftime(nx, '%Y-%m-%d') || ' ' || lpad(CAST(day(d) AS VARCHAR), 2, '0') || ':30:00' END AS next FROM n""",
    "d03_event_times": """SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') || ' ' || CASE l_returnflag WHEN 'R' THEN lpad(CAST(12 + l_linenumber AS VARCHAR), 2, '0') || ':00:00'
  WHEN 'N' THEN '09:00:00' ELSE CASE WHEN l_linestatus = 'F' THEN CASE l_linenumber WHEN 1 THEN '23' WHEN 2 THEN '12' END ELSE CAST(10 + l_linenumber AS VARCHAR) END || ':' || lpad(CAST(least(floor(l_quantity)::INTEGER, 59) AS VARCHAR), 2, '0') || ':00' END AS at FROM lineitem""",
    "x12_priors": """WITH r AS (SELECT *, CASE WHEN l_tax > 0 THEN l_shipdate::DATE END AS p, coalesce(CASE WHEN l_discount > 0 THEN l_shipdate::DATE + 10 END, CASE WHEN l_tax > 0 THEN l_shipdate::DATE END) AS e FROM lineitem),
a AS (SELECT *, coalesce(greatest(0.5::DOUBLE, 0.85::DOUBLE * pow(0.5::DOUBLE, greatest(0, epoch(TIMESTAMP '1998-01-01 12:00:00' - p::TIMESTAMP) / 86400.0) / 180)), 0.85) AS news FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, floor(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN news WHEN l_returnflag = 'R' THEN 1.2 WHEN l_returnflag = 'A' THEN CASE WHEN e >= DATE '1998-01-01' THEN 1.2 WHEN p IS NOT NULL THEN news ELSE 1 END WHEN l_linestatus = 'F' THEN 0.8 ELSE 1 END * 1e6 + 0.5) / 1e6 AS weight FROM a""",
    "x17_compared": """SELECT doc_id, sha256(trim(regexp_replace(replace(coalesce(text, ''), chr(65533), ''), '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g'))) AS mended,
  sha256(regexp_replace(array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9%$.]+'), lambda w: w <> ''), ' '), ' +%', '%', 'g')) AS compared FROM documents""",
    "x22_structured_dates": """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN d || 'T08:00' WHEN f THEN 'p' || d ELSE 't' || d END AS published_at, CASE WHEN f THEN d END AS event_start, CAST(NULL AS VARCHAR) AS event_end, CASE WHEN f THEN d || 'Z' END AS source_updated_at
  FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderstatus = 'F' AS f FROM orders)""",
    "w17_paper_lists": """WITH p AS (SELECT l_suppkey AS person, CASE WHEN l_tax > 0 THEN l_partkey END AS paper, CAST(l_orderkey AS VARCHAR) AS title, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(l_quantity AS INTEGER) AS cited FROM lineitem),
k AS (SELECT *, CASE WHEN paper IS NULL THEN 't' || title || '/' || y ELSE 'p' || paper END AS key FROM p), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY person, key ORDER BY cited DESC, title, y DESC) = 1),
u AS (SELECT person, 'top_cited' AS list, row_number() OVER (PARTITION BY person ORDER BY cited DESC, title, paper NULLS FIRST) AS place, cited, title FROM b QUALIFY place <= 5
  UNION ALL SELECT person, 'newest', row_number() OVER (PARTITION BY person ORDER BY y DESC, cited DESC, title, paper NULLS FIRST) AS place, cited, title FROM b QUALIFY place <= 5
  UNION ALL SELECT person, 'current_year', row_number() OVER (PARTITION BY person ORDER BY cited DESC, title, paper NULLS FIRST) AS place, cited, title FROM b WHERE y = 1997 QUALIFY place <= 10)
SELECT person, list, CAST(place AS INTEGER) AS place, cited, title FROM u""",
    "w19_versions": """WITH r AS (SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root, CAST(o_orderdate::DATE - DATE '1990-01-01' AS INTEGER) AS version, o_orderstatus = 'F' AND o_totalprice > 200000 AS active FROM orders),
x AS (SELECT root, arg_max(id, row(version, id)) AS cur FROM r WHERE active GROUP BY root)
SELECT id, r.root, version, (SELECT count(*) + 1 FROM r b WHERE b.root = r.root AND (b.version > r.version OR b.version = r.version AND b.id > r.id))::INTEGER AS place, CASE WHEN active THEN 'current' ELSE 'superseded' END AS state, (SELECT max(version) FROM r b WHERE b.root = r.root) AS latest, CASE WHEN NOT active THEN cur END AS restores FROM r LEFT JOIN x ON x.root = r.root""",
    "w23_running_scores": """SELECT l_orderkey AS match, l_linenumber AS line, l_partkey AS part, count(*) FILTER (WHERE l_returnflag <> 'R') OVER w AS home_score, count(*) FILTER (WHERE l_returnflag = 'R') OVER w AS away_score
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)""",
}
