"""Callable operators bound to the given tables. Their DuckDB SQL is written for itself, not derived from the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.functions import matching, phrases, profiles, safety, scalars, texts, times, urls
from korvane.operators import assembly, bindings, chunks, graph, order, people, power, records, relational, routing, sampling, scoring, slots, trends
from korvane.operators.retrieval import quantised
from korvane.plans.sql import oracle, query

Query = Callable[[SparkSession, str], DataFrame]
_CTE = {n: getattr(bindings, n) for n in ("ORG", "PEOPLE", "AREAS", "Q", "SCORES", "DOCS", "SERIES", "ASK")}


def rows(spark: SparkSession, sf_dir: str, cte: str, name: str) -> DataFrame:
    """A bound table as a DataFrame."""
    return query(f"WITH {_CTE[cte]} SELECT * FROM {name}")(spark, sf_dir)


def duck(cte: str, sql: str) -> str:
    return oracle(f"WITH {', '.join(_CTE[c] for c in cte.split())} {sql}")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orgs(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d, "ORG", "org").withColumn("slug", F.lower(F.replace("name", F.lit(" "), F.lit("-")))).withColumn("active", F.col("name") != "CHINA")


def _roles(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d, "PEOPLE", "people").select(F.col("id").alias("person"), F.col("org_id").alias("org"), "category", "title")


def _people(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d, "PEOPLE", "people").select("id", F.col("shown").alias("name"))


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d, "PEOPLE", "people").select(F.col("id").alias("person"), F.lit("balance").alias("field"), F.when(F.col("metric") > 0, F.col("metric")).alias("value"))


def _areas(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d, "AREAS", "tagged").select(F.col("person_id").alias("person"), F.col("tag").alias("area"))


def _asks(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(1, "Economy", True), (1, "brushed", None), (2, "ring", False), (3, "large plated", True), (4, "  ", True)], "id int, area string, exact boolean")


def metric_skill(s: SparkSession, d: str) -> DataFrame:
    told = people.top_by_metric(_people(s, d), _roles(s, d), _orgs(s, d), _metrics(s, d).where("value is not null"), "balance")
    return told.withColumn("value", quantised(F.col("value")))


def regressions(s: SparkSession, d: str) -> DataFrame:
    q, edge = rows(s, d, "Q", "q"), F.lit("2024-01-16 00:00:00").cast("timestamp")
    a, b = (order.places(q.where(c).groupBy("question").agg(F.count("*").alias("n")), [F.desc("n"), F.col("question")], p) for c, p in ((F.col("ts") < edge, "was"), (F.col("ts") >= edge, "now")))
    both = a.select("question", "was").join(b.select("question", "now"), "question", "left")
    return both.where("now is null or now > was + 1").select("question", F.col("now").isNull().alias("lost"))


def sequence(s: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("metric") >= 0, F.col("metric"))
    return scoring.scored_sequence(rows(s, d, "PEOPLE", "people"), key, [F.lower("shown"), F.col("slug")]).select("id", "place")


def org_ranks(s: SparkSession, d: str) -> DataFrame:
    held = query(relational.ctes(bindings.ORG, bindings.CLOSURE, bindings.PEOPLE) + "SELECT c.ancestor, p.id, p.metric FROM people p JOIN closure c ON c.id = p.org_id")(s, d)
    return order.ranks(held, "metric", "ancestor").withColumn("metric", quantised(F.col("metric")))


def toxic_words(s: SparkSession, d: str) -> DataFrame:
    told = read(s, d, "documents").select("doc_id", F.when(F.rlike(F.lower("text"), F.lit("idiot|stupid|moron|trash|scum")), 1).otherwise(0).alias("told"))
    return scoring.confusion(read(s, d, "labels").join(told, "doc_id"), "toxic", "told")


def debts(s: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("confidence") < 50, "owed").when(F.col("confidence") >= 50, "paid")
    return scoring.debt(rows(s, d, "Q", "q").select(F.col("mode").alias("stratum"), verdict.alias("verdict")), 0.5)


def rising(s: SparkSession, d: str) -> DataFrame:
    return trends.momentum(rows(s, d, "SERIES", "yearly"), 2001).where("rising").select("id", "pct", "glyph")


def peaks(s: SparkSession, d: str) -> DataFrame:
    y = rows(s, d, "SERIES", "yearly")
    return trends.peak(y.where("y >= 1995"), y.where("y < 1995").select("id", F.col("n").alias("best")))


def crawl(s: SparkSession, d: str) -> DataFrame:
    """Suppliers link to parts that came back, and parts to suppliers that delivered."""
    held = read(s, d, "lineitem")
    supplier, part = F.concat(F.lit("s/"), "l_suppkey"), F.concat(F.lit("p/"), "l_partkey")
    links = held.where("l_returnflag = 'R'").select(supplier.alias("src"), part.alias("dst")).union(held.where("l_returnflag = 'A'").select(part, supplier))
    return graph.crawl(links, s.createDataFrame([("s/1",)], "url string"), 3, 10**9)


def examples(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents by language, linked in the order of their ids where their first line is the same."""
    t = read(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("stratum"), F.sha2(F.coalesce(F.element_at(F.split("text", "\n"), 1), F.lit("")), 256).alias("h"))
    first = t.groupBy("h").agg(F.min("id").alias("a"))
    return t.select("id", "stratum"), t.join(first, "h").select("a", F.col("id").alias("b"))


def split(s: SparkSession, d: str) -> DataFrame:
    return graph.disjoint_split(*examples(s, d), F.pmod(F.crc32(F.col("component").cast("string").cast("binary")), F.lit(10)) < 3)


def clusters(s: SparkSession, d: str) -> DataFrame:
    v = read(s, d, "embeddings")
    return graph.keep_first(v.select(F.col("vec_id").alias("v")), graph.similar_pairs(v, 0.3))


def upkeep(s: SparkSession, d: str) -> DataFrame:
    lines = read(s, d, "documents").where("text is not null").select("doc_id", "lang", "source", "n_chars", F.posexplode(F.split("text", "\n")).alias("chunk", "text"))
    held = lines.where("lang <> 'fr'").select("doc_id", "chunk", F.when(F.col("n_chars") > 3000, F.reverse("text")).otherwise(F.col("text")).alias("text"))
    fresh = lines.where("lang <> 'es'").select("doc_id", "chunk", "text")
    return chunks.upkeep(fresh, held, lines.where("source <> 'src3'").select("doc_id", "chunk"))


def copies(s: SparkSession, d: str) -> DataFrame:
    a = read(s, d, "documents")
    b = a.where("not (doc_id >= 3000 and doc_id < 4000)").withColumn("lang", F.when(F.col("n_chars") > 20000, None).otherwise(F.col("lang")))
    return records.copy_faults(a, b, "doc_id", ["doc_id", "text", "lang", "n_chars"])


def feeds(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select(F.col("event_id").alias("id"), F.date_trunc("hour", "ts").alias("ts"), "event_type", F.array(F.concat(F.lit("u"), F.pmod("user_id", F.lit(20))), F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("int") % 10)).alias("tokens"))
    return records.match_feeds(e.where("event_type = 'view'"), e.where("event_type = 'click'"))


def grounded(s: SparkSession, d: str) -> DataFrame:
    c = read(s, d, "conversations").select("conv_id", "turn", "text")
    said = F.array_join(F.slice(slots.words(F.col("text")), 1, 2), " ")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), said.alias("mention"))
    return slots.grounded(c.join(before, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "mention", F.col("text").alias("message")))


def slot_people(s: SparkSession, d: str) -> DataFrame:
    p = rows(s, d, "PEOPLE", "people").select("id", F.concat_ws(" ", F.lower("given"), F.lower("surname")).alias("name"), F.col("org_id").alias("org"))
    asked = p.select("id", F.concat(F.substring("name", 1, 2), F.expr("substring(name, 4)")).alias("name"), F.concat(F.lit("who in "), F.lit("france")).alias("message"))
    return slots.person_slots(asked, p.select(F.col("id").alias("person"), "name", "org"), rows(s, d, "ORG", "org").select(F.col("id").alias("org"), F.col("name").alias("org_name")))


def plans(s: SparkSession, d: str) -> DataFrame:
    q = rows(s, d, "Q", "q")
    held = q.select("id", F.col("mode").alias("skill"), F.when(F.col("confidence").isNotNull(), F.col("user_id")).alias("person"), F.col("topic").alias("org"), F.col("question").alias("area"))
    support = held.groupBy("area").agg(F.countDistinct("person").alias("n"))
    return slots.plans(held, support, {"click": ["person"], "purchase": ["person", "org"], "view": ["area"]}, 20)


def local_week(s: SparkSession, d: str) -> DataFrame:
    return times.local_days(read(s, d, "events"), F.lit("2024-01-10 03:00:00").cast("timestamp"), 7).select("event_id")


def sentences(s: SparkSession, d: str) -> DataFrame:
    """The sentences of three words and more of all benchmark items, each with the smallest item that has it."""
    parts = read(s, d, "benchmark").select("item_id", F.explode(F.split("text", "[.!?\n]+")).alias("text")).where("length(text) - length(replace(trim(text), ' ', '')) >= 2")
    return parts.select(F.col("item_id").alias("phrase_id"), F.trim("text").alias("text"))


def masked(s: SparkSession, d: str) -> DataFrame:
    """Names of regions and nations in the texts of line items' orders are masked by their kind, the longest name first."""
    names = read(s, d, "nation").select((F.col("n_nationkey") + 100).alias("phrase_id"), F.col("n_name").alias("text"), F.lit("NATION").alias("kind"))
    names = names.union(read(s, d, "region").select("r_regionkey", "r_name", F.lit("REGION")))
    told = read(s, d, "supplier").join(read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return phrases.mask(told.select("s_suppkey", F.concat_ws(" ", "s_name", F.lit("of"), "n_name", F.lit("in"), "r_name", F.lit("not"), F.concat("n_name", F.lit("X"))).alias("text")), names)


def routes(s: SparkSession, d: str) -> DataFrame:
    """Questions that name people in three ways, routed by the rule table."""
    asked = query(f"WITH {bindings.Q}, {bindings.PEOPLE}, {bindings.ASK} SELECT id, text FROM ask")(s, d)
    folk = rows(s, d, "PEOPLE", "people").select("id", F.concat_ws(" ", F.lower("given"), F.lower("surname")).alias("name"), F.lower("surname").alias("surname"))
    told = routing.route(routing.candidates(asked, folk, rows(s, d, "ORG", "org").select("id", "name"), 0))
    return told.select("id", "rule", "skill", F.col("args")["entity_id"].alias("person"), F.col("args")["candidates"].alias("candidates"))


ROBOTS = "User-agent: *\nDisallow: /en/ # all of it\nDisallow: /*?\nAllow: /en/1\n\nUser-agent: mine\nUser-agent: ours\nDisallow: /fr/\nAllow: /fr/*ref=x$\nDisallow:\n"


def robots(s: SparkSession, d: str) -> DataFrame:
    """Pages by the rules of their hosts, for an agent without rules of its own and for one with."""
    held = read(s, d, "pages").select("page_id", "url")
    rules = safety.robots_rules(held.select(safety.host_of(F.col("url")).alias("host")).distinct().withColumn("text", F.lit(ROBOTS)))
    both = safety.robots_allowed(safety.robots_allowed(held, rules, "someone/2.0").withColumnRenamed("allowed", "anyone"), rules, "ours/1.1")
    return both.select("page_id", safety.safe_url(F.col("url")).alias("safe"), "anyone", F.col("allowed").alias("ours"))


def sampled(s: SparkSession, d: str) -> DataFrame:
    """How many of 500 documents fall to each stratum: labelled ones, and the rest by language."""
    items = read(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("stratum"))
    items = items.union(read(s, d, "labels").where("toxic is not null").select("doc_id", F.lit("labelled")).join(read(s, d, "documents").select("doc_id"), "doc_id", "semi"))
    return sampling.stratified(items, 500, 7, ["labelled"]).groupBy("stratum").agg(F.count("*").alias("drawn"))


def stages(s: SparkSession, d: str) -> DataFrame:
    """Questions with a topic are facts of their users; an unsure one is missed, by the stage of its mode."""
    q = rows(s, d, "Q", "q").where("topic is not null")
    told = power.by_stage(q.select(F.col("user_id").alias("question"), F.col("mode").alias("stage"), (F.col("confidence") < 50).alias("missed")))
    return told.withColumn("share", quantised(F.col("share")))


CUES = [("task", r"\b(tell|make|send) me\b"), ("personal", r"\b(mine|myself)\b"), ("live", r"\b(today|now)\b"), ("empty", "^[^a-z]*$")]
PROFILE_CARD = '<a [^>]*href="[^"]*"[^>]*>.*?</a>'

QUERIES: dict[str, Query] = {
    "w01_leaderboard": lambda s, d: scoring.leaderboard(rows(s, d, "SCORES", "presenter"), rows(s, d, "SCORES", "score"), ["event_id", "number"], "final_score", 2),
    "w02_dense_sequence": sequence,
    "w03_sequence": lambda s, d: order.places(rows(s, d, "PEOPLE", "people"), [F.desc("metric"), F.col("id")]).select("id", "place"),
    "w04_top_with_ties": lambda s, d: order.top_with_ties(rows(s, d, "PEOPLE", "people"), "title", 5, False).select("id", "title", "place"),
    "w14_dense_window": lambda s, d: trends.window(rows(s, d, "SERIES", "yearly"), 2001).select("id", F.aggregate("series", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total")),
    "w15_rising": rising,
    "w16_peak": peaks,
    "t05_multi_key_sort": lambda s, d: order.places(rows(s, d, "PEOPLE", "people"), [F.lower("surname"), F.lower("given"), F.col("slug")]).select("id", "place"),
    "z20_rank_regressions": regressions,
    "e23_calibration": lambda s, d: scoring.calibration(rows(s, d, "Q", "q"), "confidence", F.col("topic").isNotNull()),
    "a16_metric_ranking": org_ranks,
    "a16_metric_skill": metric_skill,
    "a22_coverage_skill": lambda s, d: people.metric_coverage(_people(s, d), _roles(s, d), _orgs(s, d), _metrics(s, d), "balance"),
    "a13_area_skill": lambda s, d: people.area_counts(_areas(s, d), _roles(s, d), _orgs(s, d)),
    "u02_area_hits": lambda s, d: people.people_by_area(_areas(s, d), _asks(s)),
    "j01_people_skill": lambda s, d: people.people_in_org(_people(s, d), _roles(s, d), _orgs(s, d), ["faculty", "joint"]),
    "p07_orgs_by_type": lambda s, d: people.orgs_by_type(_orgs(s, d), "department", 3),
    "h09_resolve_org": lambda s, d: people.resolve_org(_orgs(s, d), rows(s, d, "ORG", "org").select("id", F.upper("name").alias("name")), s.createDataFrame([("world", "asia")], "alias string, slug string")),
    "a25_confusion": lambda s, d: scoring.agreement(rows(s, d, "Q", "q").withColumn("told", F.when(F.col("confidence") >= 50, F.col("mode"))), "mode", "topic", "told"),
    "a27_accuracy": toxic_words,
    "a30_debt_report": debts,
    "x21_canonical_url": lambda s, d: read(s, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical")),
    "x27_containment": lambda s, d: matching.grounding(read(s, d, "benchmark"), read(s, d, "documents")),
    "p06_all_tokens": lambda s, d: matching.covering(matching.asked_tokens(read(s, d, "benchmark")), read(s, d, "documents"), 1.0).select("item_id", "doc_id"),
    "j09_mentions": lambda s, d: matching.mentions(read(s, d, "benchmark").select("item_id", F.array_join(F.slice(matching.tokens(F.col("text")), 1, 2), " ").alias("text")), read(s, d, "documents")).select(F.col("item_id").alias("person"), "doc_id"),
    "n02_deflect_gate": lambda s, d: matching.gate(read(s, d, "conversations"), CUES).select("conv_id", "turn", "gate"),
    "s04_crawl": crawl,
    "h12_components": lambda s, d: graph.components(examples(s, d)[1]),
    "e22_disjoint_split": split,
    "w20_keep_first": clusters,
    "e10_token_windows": lambda s, d: chunks.chunks(read(s, d, "documents")).select("doc_id", "chunk", "n_tokens", F.sha2("text", 256).alias("digest")),
    "e11_chunk_upkeep": upkeep,
    "s15_copy_faults": copies,
    "j10_match_feeds": feeds,
    "x14_context": lambda s, d: texts.context_words(read(s, d, "conversations")),
    "n14_grounded": grounded,
    "n16_person_slots": slot_people,
    "n17_plans": plans,
    "d05_local_week": local_week,
    "d08_local_clock": lambda s, d: read(s, d, "events").select("event_id", times.shown(F.col("ts")).alias("shown"), times.utc(F.col("ts")).cast("string").alias("as_utc")),
    "z12_listing": lambda s, d: profiles.listing(read(s, d, "pages"), PROFILE_CARD).select("page_id", "n", "section", "name"),
    "t11_longest_phrase": lambda s, d: phrases.longest(read(s, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), sentences(s, d), overlapping=True).select("text_id", "words"),
    "x31_masked_names": masked,
    "n08_rule_routes": routes,
    "a32_power_by_stage": stages,
    "s03_robots": robots,
    "e21_allocation": sampled,
    "x24_citations": lambda s, d: profiles.citations(read(s, d, "documents").select(F.col("doc_id").alias("id"), "text")),
}

_ORGS = "orgs AS (SELECT *, lower(replace(name, ' ', '-')) AS slug, name <> 'CHINA' AS active FROM org)"
_REACH = """, reach AS (SELECT id AS ancestor, id FROM orgs UNION ALL SELECT p.id, c.id FROM orgs p JOIN orgs c ON c.parent_id = p.id WHERE c.active
  UNION ALL SELECT g.id, c.id FROM orgs g JOIN orgs p ON p.parent_id = g.id AND p.active JOIN orgs c ON c.parent_id = p.id AND c.active)"""
_TS = "list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]', ' ', 'g'), ' '), lambda t: length(t) > 1))"
_FIRST = "coalesce(string_split(text, chr(10))[1], '')"
_LINES = "ln AS (SELECT doc_id, lang, source, n_chars, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS chunk, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL)"


def _stop() -> str:
    from korvane.operators.retrieval import STOP

    return ", ".join(f"'{w}'" for w in STOP)


_ASKED = f"""a0 AS (SELECT item_id, {_TS.format('text')} AS ts FROM benchmark),
a1 AS (SELECT item_id, CASE WHEN len(list_filter(ts, lambda t: t NOT IN ({_stop()}))) > 0 THEN list_filter(ts, lambda t: t NOT IN ({_stop()})) ELSE ts END AS ts FROM a0),
ask AS (SELECT item_id, len(ts) AS n, unnest(ts) AS token FROM a1),
held AS (SELECT * FROM (SELECT doc_id, unnest({_TS.format('text')}) AS token FROM documents) WHERE token IN (SELECT token FROM ask)),
hits AS (SELECT item_id, doc_id, count(*) AS shared, max(n) AS n FROM ask JOIN held USING (token) GROUP BY item_id, doc_id)"""
_FAR = {k: oracle(v) for k, v in (relational.SQL | assembly.SQL | scalars.SQL | texts.SQL).items()}

ORACLES: dict[str, str] = {
    **{k: _FAR[k] for k in ("w01_leaderboard", "w02_dense_sequence", "w03_sequence", "w04_top_with_ties", "w14_dense_window", "w15_rising", "t05_multi_key_sort", "z20_rank_regressions", "e23_calibration", "a16_metric_ranking", "x14_context")},
    "w16_peak": duck("SERIES", """, top AS (SELECT id, arg_max(y, n * 10000 - y) AS y, max(n) AS n FROM yearly WHERE y >= 1995 GROUP BY id)
SELECT t.id, t.y, t.n, t.n > coalesce((SELECT max(n) FROM yearly e WHERE e.id = t.id AND e.y < 1995), 0) AS is_all_time FROM top t"""),
    "a16_metric_skill": duck("ORG PEOPLE", f""", {_ORGS}{_REACH}, best AS (SELECT DISTINCT r.ancestor AS org, p.id AS person, p.metric AS value FROM people p JOIN reach r ON r.id = p.org_id WHERE p.metric > 0)
SELECT org, person, floor(value * 1e6 + 0.5) / 1e6 AS value, (SELECT count(*) + 1 FROM best b WHERE b.org = a.org AND b.value > a.value) AS place FROM best a"""),
    "a22_coverage_skill": duck("ORG PEOPLE", f", {_ORGS}{_REACH} SELECT r.ancestor AS org, count(DISTINCT CASE WHEN p.metric > 0 THEN p.id END) AS with_metric, count(DISTINCT p.id) AS total FROM people p JOIN reach r ON r.id = p.org_id GROUP BY r.ancestor"),
    "a13_area_skill": duck("ORG PEOPLE AREAS", f""", {_ORGS}{_REACH}, spelled AS (SELECT lower(tag) AS f, tag, count(*) AS n FROM tagged GROUP BY tag),
named AS (SELECT f, min(tag) AS area FROM spelled s WHERE n = (SELECT max(n) FROM spelled m WHERE m.f = s.f) GROUP BY f)
SELECT r.ancestor AS org, n.area, count(DISTINCT t.person_id) AS people FROM tagged t JOIN people p ON p.id = t.person_id JOIN reach r ON r.id = p.org_id JOIN named n ON n.f = lower(t.tag) GROUP BY r.ancestor, n.area"""),
    "u02_area_hits": duck("AREAS", """, asks(id, w, exact) AS (VALUES (1, 'economy', true), (1, 'brushed', false), (2, 'ring', false), (3, 'large plated', true))
SELECT id, person_id AS person, CASE WHEN max(CAST(exact AS INTEGER)) = 1 THEN 'exact' ELSE 'expanded' END AS hit FROM tagged JOIN asks
  ON regexp_matches(' ' || lower(tag) || ' ', '[^a-z0-9]' || replace(w, ' ', '[^a-z0-9]+') || '[^a-z0-9]') GROUP BY id, person_id"""),
    "j01_people_skill": duck("ORG PEOPLE", f", {_ORGS}{_REACH} SELECT r.ancestor AS org, p.id AS person, any_value(p.shown) AS name, min(p.title) AS title FROM people p JOIN reach r ON r.id = p.org_id WHERE p.category IN ('faculty', 'joint') GROUP BY r.ancestor, p.id"),
    "p07_orgs_by_type": "SELECT CAST(100 + n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_regionkey = 2 AND n_name <> 'CHINA'",
    "h09_resolve_org": duck("ORG", "SELECT id, CASE WHEN name = 'CHINA' THEN NULL ELSE id END AS org FROM org"),
    "a25_confusion": duck("Q", """, t AS (SELECT mode, coalesce(topic, 'none') AS t, CASE WHEN confidence >= 50 THEN mode ELSE 'none' END AS p FROM q),
w AS (SELECT mode, t || '>' || p AS worst, row_number() OVER (PARTITION BY mode ORDER BY count(*) DESC, t, p) AS r FROM t WHERE t <> p GROUP BY mode, t, p)
SELECT t.mode, count(*) AS n, CAST(sum(CAST(t.t = t.p AS BIGINT)) AS BIGINT) AS agree, floor(avg(CAST(t.t = t.p AS DOUBLE)) * 1e6 + 0.5) / 1e6 AS rate, any_value(w.worst) AS worst
FROM t LEFT JOIN w ON w.mode = t.mode AND w.r = 1 GROUP BY t.mode"""),
    "a27_accuracy": """WITH x AS (SELECT toxic = 1 AS y, regexp_matches(lower(coalesce(text, '')), 'idiot|stupid|moron|trash|scum') AS p FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL)
SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn,
  floor(avg(CAST(y = p AS DOUBLE)) * 1e6 + 0.5) / 1e6 AS accuracy, floor(count(*) FILTER (y AND NOT p)::DOUBLE / count(*) FILTER (y) * 1e6 + 0.5) / 1e6 AS miss_rate, count(*) FILTER (y AND NOT p) AS leaks FROM x""",
    "a30_debt_report": duck("Q", """SELECT mode AS stratum, count(*) AS facts, count(*) FILTER (confidence >= 50) AS paid, count(*) FILTER (confidence < 50) AS owed, count(*) FILTER (confidence IS NULL) AS unknown,
  CASE WHEN count(confidence) > 0 THEN floor(count(*) FILTER (confidence < 50)::DOUBLE / count(confidence) * 1e6 + 0.5) / 1e6 END AS ratio,
  coalesce(floor(count(*) FILTER (confidence < 50)::DOUBLE / nullif(count(confidence), 0) * 1e6 + 0.5) / 1e6 > 0.5, false) AS "over" FROM q GROUP BY mode"""),
    "x21_canonical_url": """SELECT page_id, CASE WHEN regexp_matches(url, '^[hH][tT][tT][pP][sS]?://[^/?#]') THEN 'https://' || lower(host) ||
  CASE WHEN path <> '' AND rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || search ELSE url END AS canonical
FROM (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(split_part(url, '#', 1), '([?].*)$', 1) AS search FROM pages)""",
    "x27_containment": f"WITH {_ASKED} SELECT item_id, doc_id, floor(shared::DOUBLE / n * 1e6 + 0.5) / 1e6 AS overlap FROM hits WHERE shared::DOUBLE / n >= 0.7 - 1e-9",
    "p06_all_tokens": f"WITH {_ASKED} SELECT item_id, doc_id FROM hits WHERE shared = n",
    "j09_mentions": f"""WITH nm AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' '), lambda t: length(t) > 1)[1:2] AS ts FROM benchmark),
ask AS (SELECT item_id, unnest(list_distinct(ts)) AS token, len(list_distinct(ts)) AS n FROM nm),
held AS (SELECT * FROM (SELECT doc_id, unnest({_TS.format('text')}) AS token FROM documents) WHERE token IN (SELECT token FROM ask))
SELECT item_id AS person, doc_id FROM ask JOIN held USING (token) GROUP BY item_id, doc_id HAVING count(*) = max(n)""",
    "n02_deflect_gate": """SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(^|[^a-z0-9_])(tell|make|send) me($|[^a-z0-9_])') THEN 'task' WHEN regexp_matches(t, '(^|[^a-z0-9_])(mine|myself)($|[^a-z0-9_])') THEN 'personal'
  WHEN regexp_matches(t, '(^|[^a-z0-9_])(today|now)($|[^a-z0-9_])') THEN 'live' WHEN NOT regexp_matches(t, '[a-z]') THEN 'empty' ELSE 'answerable' END AS gate FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)""",
    "s04_crawl": """WITH RECURSIVE links AS (SELECT DISTINCT 's/' || l_suppkey AS src, 'p/' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'
  UNION SELECT 'p/' || l_partkey, 's/' || l_suppkey FROM lineitem WHERE l_returnflag = 'A'),
walk AS (SELECT 's/1' AS url, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN links ON src = url WHERE depth < 3)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY url""",
    "h12_components": f"SELECT doc_id AS v, min(doc_id) OVER (PARTITION BY {_FIRST}) AS component FROM documents",
    "w20_keep_first": """WITH RECURSIVE n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, i, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM n),
p AS MATERIALIZED (SELECT a.i AS a, b.i AS b FROM u a JOIN u b ON a.i < b.i WHERE floor(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) * 1e6 + 0.5) / 1e6 >= 0.3),
g AS MATERIALIZED (SELECT b, list(a) AS earlier FROM p GROUP BY b),
k AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT k.i + 1, CASE WHEN len(list_intersect(coalesce((SELECT earlier FROM g WHERE g.b = k.i + 1), CAST([] AS BIGINT[])), kept)) = 0 THEN list_append(kept, k.i + 1) ELSE kept END FROM k WHERE k.i < (SELECT count(*) FROM n))
SELECT vec_id AS v, list_contains((SELECT arg_max(kept, i) FROM k), i) AS kept FROM n""",
    "e11_chunk_upkeep": f"""WITH {_LINES}, f AS (SELECT doc_id, chunk, text FROM ln WHERE lang <> 'es'),
h AS (SELECT doc_id, chunk, CASE WHEN n_chars > 3000 THEN reverse(text) ELSE text END AS text FROM ln WHERE lang <> 'fr'), v AS (SELECT doc_id, chunk FROM ln WHERE source <> 'src3'),
k AS (SELECT doc_id, chunk FROM f UNION SELECT doc_id, chunk FROM h UNION SELECT doc_id, chunk FROM v)
SELECT * FROM (SELECT k.doc_id, k.chunk, CASE WHEN f.text IS NULL AND h.text IS NULL THEN 'drop_vector' WHEN f.text IS NULL THEN 'delete' WHEN h.text IS NULL THEN 'insert' WHEN f.text <> h.text THEN 'update'
  WHEN v.doc_id IS NULL THEN 'embed' END AS action FROM k LEFT JOIN f USING (doc_id, chunk) LEFT JOIN h USING (doc_id, chunk) LEFT JOIN v USING (doc_id, chunk)) WHERE action IS NOT NULL""",
    "s15_copy_faults": """SELECT CAST(doc_id // 1000 AS BIGINT) AS bucket, CASE WHEN doc_id // 1000 = 3 THEN 'missing' ELSE 'different' END AS fault FROM documents WHERE doc_id // 1000 = 3 OR (n_chars > 20000 AND lang IS NOT NULL) GROUP BY doc_id // 1000""",
    "n17_plans": duck("Q", """, h AS (SELECT id, mode, CASE WHEN confidence IS NOT NULL THEN user_id END AS person, topic, question AS area FROM q), s AS (SELECT area, count(DISTINCT person) AS n FROM h GROUP BY area)
SELECT id, CASE WHEN reason IS NULL THEN 'execute' ELSE 'abstain' END AS verdict, reason FROM (SELECT id, CASE WHEN mode NOT IN ('click', 'purchase', 'view') THEN 'unknown skill'
  WHEN mode IN ('click', 'purchase') AND person IS NULL THEN 'missing person' WHEN mode = 'purchase' AND topic IS NULL THEN 'missing org' WHEN mode = 'view' AND h.area IS NULL THEN 'missing area'
  WHEN mode = 'view' AND coalesce(n, 0) < 20 THEN 'thin area' END AS reason FROM h LEFT JOIN s ON s.area = h.area)"""),
    "t11_longest_phrase": """WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+'), ' ') || ' ' AS s FROM documents),
p AS (SELECT DISTINCT regexp_extract_all(lower(x), '[\\p{L}\\p{N}\\p{M}]+') AS q FROM (SELECT unnest(regexp_split_to_array(text, '[.!?\n]+')) AS x FROM benchmark) WHERE length(x) - length(replace(trim(x), ' ', '')) >= 2),
f AS (SELECT len(q) AS n, ' ' || array_to_string(q, ' ') || ' ' AS s FROM p WHERE len(q) > 0)
SELECT doc_id AS text_id, CAST(max(n) AS BIGINT) AS words FROM w JOIN f ON contains(w.s, f.s) GROUP BY doc_id""",
    "x31_masked_names": "SELECT s_suppkey, s_name || ' of <NATION> in <REGION> not ' || n_name || 'X' AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "n08_rule_routes": duck("Q PEOPLE ASK", """, f AS (SELECT lower(given) || ' ' || lower(surname) AS w, count(*) AS n, min(id) AS person FROM people GROUP BY ALL),
s AS (SELECT lower(surname) AS w, count(*) AS n, min(id) AS person FROM people GROUP BY ALL), a AS (SELECT id, id % 3 AS kind, regexp_replace(text, '^(who is|papers by|what about) ', '') AS w FROM ask),
t AS (SELECT a.id, kind, coalesce(f.n, s.n) AS n, coalesce(f.person, s.person) AS person, CASE kind WHEN 1 THEN 'papers' ELSE 'a person' END AS rule, CASE kind WHEN 1 THEN 'papers_of_person' ELSE 'entity_card' END AS skill
  FROM a LEFT JOIN f ON f.w = a.w LEFT JOIN s ON s.w = a.w)
SELECT id, CASE WHEN n = 1 THEN rule WHEN n > 1 THEN rule || ', several people' END AS rule, CASE WHEN n = 1 THEN skill WHEN n > 1 THEN 'person_disambig' END AS skill,
  CASE WHEN n = 1 THEN CAST(person AS VARCHAR) END AS person, CASE WHEN n > 1 THEN CAST(n AS VARCHAR) END AS candidates FROM t"""),
    "a32_power_by_stage": duck("Q", """, f AS (SELECT user_id, mode, coalesce(confidence < 50, false) AS missed FROM q WHERE topic IS NOT NULL AND user_id IS NOT NULL),
z AS (SELECT count(*)::DOUBLE / count(DISTINCT user_id) AS per, count(*) FILTER (missed) AS total FROM f)
SELECT mode AS stage, count(*) AS misses, floor(count(*)::DOUBLE / any_value(total) * 1e6 + 0.5) / 1e6 AS share,
  CAST(round_even(3.8416::DOUBLE * ((count(*) + 2)::DOUBLE / (any_value(total) + 4)) * (1 - (count(*) + 2)::DOUBLE / (any_value(total) + 4)) / 0.01::DOUBLE / any_value(per), 0) AS BIGINT) AS questions
FROM f, z WHERE missed GROUP BY mode"""),
    "s03_robots": """WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS path FROM pages)
SELECT page_id, coalesce(regexp_matches(host, '^[a-z0-9_-]+([.][a-z0-9_-]+)*[.][a-z][a-z0-9-]*$') AND NOT regexp_matches(host, '[.](local|internal|lan|home|intranet|localdomain)$'), false) AS safe,
  coalesce(path LIKE '/en/1%' OR NOT (path LIKE '/en/%' OR path LIKE '%?%'), true) AS anyone, coalesce(NOT path LIKE '/fr/%' OR path LIKE '/fr/%ref=x', true) AS ours FROM p""",
    "e21_allocation": """WITH i AS (SELECT doc_id, CASE WHEN bool_or(l) THEN 'labelled' ELSE min(lang) END AS stratum FROM (SELECT doc_id, lang, false AS l FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT doc_id, NULL, true FROM labels WHERE toxic IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents)) GROUP BY doc_id),
z AS (SELECT stratum, count(*) AS size FROM i GROUP BY stratum), t AS (SELECT sum(size) AS total, least(500, sum(size)) AS n FROM z),
q AS (SELECT stratum, CAST(n * size // total AS BIGINT) AS low, n * size % total AS rest, n FROM z, t)
SELECT stratum, low + CAST(row_number() OVER (ORDER BY rest DESC, stratum) <= n - (SELECT sum(low) FROM q) AS BIGINT) AS drawn FROM q QUALIFY drawn > 0""",
    "d05_local_week": "SELECT event_id FROM events WHERE CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) BETWEEN DATE '2024-01-09' AND DATE '2024-01-16'",
    "d08_local_clock": """SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%b %-d, %-I:%M %p') AS shown,
  rtrim(rtrim(strftime(timezone('UTC', timezone('America/New_York', ts)), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS as_utc FROM events""",
}
