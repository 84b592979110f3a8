"""Ordered rules, judged runs and evidence bound to the given tables. Words are parameters of both engines; the rules' logic is written twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.operators import evidence, scoring, screens
from korvane.plans.bound import duck, read, rows
from korvane.plans.retrieval import _KEYWORD, _PAIRS, _PLAIN, _STOP, _TS, _near, questions

Query = Callable[[SparkSession, str], DataFrame]
OTHERS, OWN = ["northtown", "eastern college"], "own university"


def _lines(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem")


def intents(s: SparkSession, d: str) -> DataFrame:
    return screens.intents(read(s, d, "conversations")).select("conv_id", "turn", "intent", "confidence")


def deflections(s: SparkSession, d: str) -> DataFrame:
    told = screens.deflected(read(s, d, "conversations"), screens.deflections(OTHERS, OWN))
    return told.select("conv_id", "turn", "deflect", "family", "cue", screens.fact_shaped(F.col("text")).alias("fact_shaped"))


def decisions(s: SparkSession, d: str) -> DataFrame:
    """Events as questions: errors carry a cue, a click is judged absent, a small number asks for a figure."""
    q = rows(s, d, "Q", "q").select("id", F.when(F.col("mode") == "error", F.col("topic")).alias("cue"), (F.col("confidence") / 100).alias("score"), F.when(F.col("mode") == "click", "NOT_IN_CONTEXT").when(F.col("mode") == "view", "FULLY_SUPPORTED").alias("label"), (F.col("k") < 20).alias("fact_shaped"))
    return screens.decided(q, 0.3).select("id", "outcome", "check", "skip_fallback")


def ladder(s: SparkSession, d: str) -> DataFrame:
    """Orders as questions, their lines as results: the flags of a line are its tier; an untaxed line has no score."""
    tier = F.when(F.col("l_returnflag") == "N", "primary").when(F.col("l_returnflag") == "R", "office").when(F.col("l_linestatus") == "F", "deep").otherwise("live")
    results = _lines(s, d).select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("doc_id"), tier.alias("tier"), F.col("l_linenumber").alias("place"), F.when(F.col("l_tax") > 0, F.col("l_discount") * 5).alias("score"))
    return screens.ladder(read(s, d, "orders").select(F.col("o_orderkey").alias("item_id")), results)


def pages(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "pages")
    return p.select("page_id", screens.page_kind(F.col("url")).alias("kind"), screens.stakes(F.col("url"), F.col("html"), F.rlike("html", F.lit("[$] ?[0-9]|[0-9] ?%"))).alias("stakes"))


def titles(s: SparkSession, d: str) -> DataFrame:
    p = rows(s, d, "PEOPLE", "people").withColumn("r", screens.seniority(F.col("title")))
    return p.select("id", screens.role_category(F.split("title", " and ")).alias("role"), "r.rank", "r.label")


def foods(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return read(s, d, "documents").select("doc_id", screens.asks_for_food(c("text")).alias("asks"), screens.event_has_food(c("lang"), c("source"), c("text")).alias("serves"))


def runs(s: SparkSession, d: str) -> DataFrame:
    """Lines as questions; what their order says stands for the judged run."""
    skill = F.when(F.col("l_returnflag") == "R", "metric_of_person").when(F.col("l_returnflag") == "A", "link_of_person").otherwise("entity_card")
    gold = _lines(s, d).select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "KG").otherwise("RAG").alias("gold_family"), skill.alias("gold_skill"))
    urgency = F.col("o_orderpriority")
    told = read(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "KG").when(F.col("o_orderstatus") == "O", "RAG").alias("told_family"), F.when(urgency == "1-URGENT", "metric_of_person").when(urgency == "2-HIGH", "link_of_person").when(urgency == "3-MEDIUM", "entity_card").alias("told_skill"))
    return gold.join(told, "o_orderkey")


def slots(s: SparkSession, d: str) -> DataFrame:
    """Orders as questions, the state of a line as a slot, its flag and number as the value; taxed lines are told."""
    asked = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("skill"))
    held = _lines(s, d).select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("slot"), F.concat(F.lit(" "), "l_returnflag", "l_linenumber").alias("value"), "l_returnflag", "l_tax")
    return scoring.slot_scores(asked, held.where("l_returnflag <> 'N'"), held.where("l_tax > 0.02"), ("F", "O"))


def present(s: SparkSession, d: str) -> DataFrame:
    """Benchmark items as facts; documents, names of people and vectors as what may hold them."""
    asked, items, nodes = questions(s, d), read(s, d, "documents").select("doc_id", "text"), rows(s, d, "PEOPLE", "people").select(F.col("id").alias("node_id"), F.col("shown").alias("text"))
    facts = asked.select(F.col("item_id").alias("fact_id"), "text")
    found = evidence.gathered(facts, items, nodes, read(s, d, "embeddings"), asked, 20, 100)
    spans = items.select(F.lit("item").alias("kind"), F.col("doc_id").alias("ref"), "text").union(nodes.select(F.lit("node"), "node_id", "text"))
    return evidence.presence(facts, evidence.judged(found, facts, spans))


QUERIES: dict[str, Query] = {
    "n01_intent_rules": intents,
    "n02_deflections": deflections,
    "n03_decisions": decisions,
    "n18_ladder": ladder,
    "p09_screened": lambda s, d: screens.screened(read(s, d, "conversations")).select("conv_id", "turn", "refused"),
    "p10_foods": foods,
    "p11_page_stakes": pages,
    "p13_roles_and_ranks": titles,
    "a27_dispatch": lambda s, d: scoring.dispatch(runs(s, d)),
    "a27_dispatch_confusion": lambda s, d: scoring.dispatch_confusion(runs(s, d)),
    "a28_slot_scores": slots,
    "e24_evidence": present,
}

_FLAT = "trim(regexp_replace(lower(coalesce({}, '')), '[ \\t\\r\\n\\f]+', ' ', 'g'))"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(pattern: str, text: str = "t") -> str:
    return f"regexp_matches({text}, {_q('(^|[^a-z0-9_])(' + pattern + ')($|[^a-z0-9_])')})"


def _some(words: tuple[str, ...], text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


_I = {c.name: c.pattern for c in screens.INTENTS}
_LIST = lambda ws: "[" + ", ".join(_q(w) for w in ws) + "]"
_P = {i: c for i, c in enumerate(screens.deflections(OTHERS, OWN))}
_TITLES = "(SELECT id, title, lower(title) AS t FROM people)"
_SLOTS = """WITH asked AS (SELECT o_orderkey AS id, o_orderpriority AS skill FROM orders),
g AS (SELECT DISTINCT l_orderkey AS id, l_linestatus, lower(l_returnflag) || l_linenumber AS v FROM lineitem WHERE l_returnflag <> 'N'),
t AS (SELECT DISTINCT l_orderkey AS id, l_linestatus, lower(l_returnflag) || l_linenumber AS v FROM lineitem WHERE l_tax > 0.02),
e AS (SELECT a.id, a.skill, (SELECT count(*) FROM g SEMI JOIN t USING (id, l_linestatus, v) WHERE g.id = a.id) AS tp, (SELECT count(*) FROM g WHERE g.id = a.id) AS ng, (SELECT count(*) FROM t WHERE t.id = a.id) AS nt FROM asked a),
s AS (SELECT skill, count(*) AS n, sum(tp)::BIGINT AS tp, sum(nt - tp)::BIGINT AS fp, sum(ng - tp)::BIGINT AS fn, count(*) FILTER (WHERE ng = tp AND nt = tp) AS same FROM e GROUP BY GROUPING SETS ((skill), ())),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1.0 ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS rc FROM s)
SELECT skill, n, tp, fp, fn, floor(pr * 1e6 + 0.5) / 1e6 AS precision, floor(rc * 1e6 + 0.5) / 1e6 AS recall, floor(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * 1e6 + 0.5) / 1e6 AS f1, floor(same / n * 1e6 + 0.5) / 1e6 AS exact FROM p"""
_RUN = """WITH r AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'KG' ELSE 'RAG' END AS gf, CASE l_returnflag WHEN 'R' THEN 'metric_of_person' WHEN 'A' THEN 'link_of_person' ELSE 'entity_card' END AS gs,
  CASE o_orderstatus WHEN 'F' THEN 'KG' WHEN 'O' THEN 'RAG' END AS tf, CASE o_orderpriority WHEN '1-URGENT' THEN 'metric_of_person' WHEN '2-HIGH' THEN 'link_of_person' WHEN '3-MEDIUM' THEN 'entity_card' END AS ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
_SAID = f"""said AS (SELECT DISTINCT item_id, array_to_string({_TS.format('run')}, ' ') AS w, kind FROM (
  SELECT item_id, unnest(regexp_extract_all(text, {_q(evidence.RUNS)})) AS run, 'phrase' AS kind FROM benchmark UNION ALL SELECT item_id, unnest(regexp_extract_all(text, {_q(evidence.NAMES)})), 'name' FROM benchmark)),
span AS (SELECT 'item' AS kind, doc_id AS ref, {_TS.format('text')} AS ws FROM documents UNION ALL SELECT 'node', id, {_TS.format('shown')} FROM people),
flat AS (SELECT kind, ref, ' ' || array_to_string(ws, ' ') || ' ' AS f FROM span)"""

ORACLES: dict[str, str] = {
    "n01_intent_rules": f"""WITH c AS (SELECT conv_id, turn, {_FLAT.format('text')} AS t FROM conversations), i AS (SELECT conv_id, turn, CASE WHEN {_in(_I['clear_history'])} THEN 'clear_history'
  WHEN {_in(_I['free_mode'])} THEN 'free_mode' WHEN {_in(_I['topic_mode'])} THEN 'topic_mode' WHEN {_some(screens.FOOD)} AND NOT {_some(screens.FOOD_GUARD)} THEN 'food' WHEN length(t) < 40 AND {_in(_I['social'])} THEN 'social'
  WHEN length(t) < 30 AND {_in(_I['greeting'])} THEN 'greeting' WHEN length(t) < 40 AND {_in(_I['farewell'])} THEN 'farewell' WHEN length(t) < 50 AND {_in(_I['thanks'])} THEN 'thanks' WHEN {_in(_I['help'])} THEN 'help'
  WHEN {_in(_I['identity'])} THEN 'identity' WHEN suffix(t, '?') OR len(list_intersect(string_split(t, ' ')[1:3], {_LIST(screens.STARTERS)})) > 0 THEN 'question' ELSE 'statement' END AS intent FROM c)
SELECT conv_id, turn, intent, CASE intent WHEN 'statement' THEN 0.5::DOUBLE WHEN 'question' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM i""",
    "n02_deflections": f"""WITH c AS (SELECT conv_id, turn, {_FLAT.format('text')} AS t FROM conversations), g AS (SELECT *, {_in(screens.GUIDANCE)} AS guided,
  CASE WHEN NOT guided AND {_in(_P[0].pattern)} THEN 0 WHEN NOT guided AND {_in(_P[1].pattern)} THEN 1 WHEN NOT guided AND {_in(_P[2].also)} AND {_in(_P[2].pattern)} THEN 2 WHEN NOT guided AND {_in(_P[3].pattern)} THEN 3
  WHEN {_some(tuple(OTHERS))} AND {_in('|'.join(OTHERS))} AND NOT ({_in('transfer[a-z]*')} AND {_in(OWN)}) THEN 4 WHEN {_in('my')} AND {_in(_P[5].pattern)} THEN 5 WHEN {_in(_P[6].pattern)} AND {_in(_P[6].also)} AND NOT {_in('events?|menu|dining')} THEN 6 END AS rule FROM c)
SELECT conv_id, turn, rule IS NOT NULL AS deflect, {_LIST(c.name for c in _P.values())}[rule + 1] AS family, CASE rule {' '.join(f"WHEN {i} THEN regexp_extract(t, {_q('(^|[^a-z0-9_])(' + c.pattern + ')($|[^a-z0-9_])')}, 2)" for i, c in _P.items())} END AS cue, {_in(screens.FIGURES)} AS fact_shaped FROM g""",
    "n03_decisions": duck("Q", """SELECT id, CASE WHEN turned THEN 'deflect' WHEN mode = 'click' AND (figure OR low) THEN 'fallback' ELSE 'answer' END AS outcome, NOT turned AND (figure OR low) AS "check", turned AS skip_fallback
  FROM (SELECT id, mode, mode = 'error' AND topic IS NOT NULL AND topic <> '' AS turned, coalesce(confidence / 100 < 0.3, true) AS low, coalesce(k < 20, false) AS figure FROM q)"""),
    "n18_ladder": """WITH r AS (SELECT l_orderkey AS item_id, CASE WHEN l_returnflag = 'N' THEN 'primary' WHEN l_returnflag = 'R' THEN 'office' WHEN l_linestatus = 'F' THEN 'deep' ELSE 'live' END AS tier,
  CASE WHEN l_tax > 0 THEN l_discount * 5 END AS score, row(l_linenumber, l_partkey, l_discount) AS pos FROM lineitem),
o AS (SELECT DISTINCT o_orderkey AS item_id FROM orders), f AS (SELECT item_id, tier, arg_min(score, pos) FILTER (WHERE score IS NOT NULL) AS rel FROM r GROUP BY ALL),
w AS (SELECT o.item_id, p.item_id IS NULL OR coalesce(p.rel < 0.15, false) AS miss, p.item_id IS NOT NULL AS has, l.item_id IS NOT NULL AS lives, p.rel AS pr, f.rel AS fr, d.rel AS dr, l.rel AS lr FROM o
  LEFT JOIN f p ON p.item_id = o.item_id AND p.tier = 'primary' LEFT JOIN f ON f.item_id = o.item_id AND f.tier = 'office' LEFT JOIN f d ON d.item_id = o.item_id AND d.tier = 'deep' LEFT JOIN f l ON l.item_id = o.item_id AND l.tier = 'live'),
t AS (SELECT *, CASE WHEN NOT miss THEN 'primary' WHEN fr >= 0.15 THEN 'office' WHEN dr >= 0.3 AND (pr IS NULL OR dr > pr) THEN 'deep' WHEN lives THEN 'live' WHEN has THEN 'primary' ELSE 'none' END AS tier FROM w)
SELECT item_id, tier, miss, pr AS primary_relevance, CASE tier WHEN 'primary' THEN pr WHEN 'office' THEN fr WHEN 'deep' THEN dr WHEN 'live' THEN lr END AS relevance FROM t""",
    "p09_screened": f"""SELECT conv_id, turn, CASE WHEN len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\r\\n\\f]+'), lambda w: w <> '')) < 3 THEN 'short' WHEN regexp_matches(text, {_q(screens.MAIL)}) THEN 'mail' END AS refused FROM conversations""",
    "p10_foods": f"""WITH d AS (SELECT doc_id, lang, source, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, {_some(screens.FOOD)} AND NOT {_some(screens.FOOD_GUARD, 'trim(t)')} AS asks, coalesce(lower(lang) IN ('food', 'social'), false) OR {_some(screens.FOOD)} OR {_some(screens.FOOD, "lower(coalesce(source, ''))")} AS serves FROM d""",
    "p11_page_stakes": f"""WITH p AS (SELECT page_id, {_FLAT.format('html')} AS t, lower(coalesce(url, '')) AS u, coalesce(regexp_matches(html, '[$] ?[0-9]|[0-9] ?%'), false) AS held,
  list_filter(string_split(regexp_extract(regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://[^/?#]*', ''), '^[^?#]*'), '/'), lambda s: s <> '') AS s FROM pages)
SELECT page_id, CASE WHEN len(list_filter(s, lambda x: list_contains({_LIST(screens.PEOPLE)}, x) OR list_contains({_LIST(screens.PEOPLE)}, regexp_replace(x, '-[0-9]+$', '')))) > 0 THEN 'people' WHEN len(list_intersect(s, {_LIST(screens.NEWS)})) > 0 THEN 'news'
  WHEN len(list_intersect(s, {_LIST(screens.EVENTS)})) > 0 THEN 'event' ELSE 'policy' END AS kind,
  CASE WHEN {_in('|'.join(screens.HIGH_TERMS))} OR {' OR '.join(f"regexp_matches(t, {_q('(^|[^a-z0-9_])' + w)})" for w in screens.HIGH_STEMS)} OR (held AND {_some(screens.HIGH_TREES, 'u')}) THEN 'high' ELSE 'low' END AS stakes FROM p""",
    "p13_roles_and_ranks": duck("PEOPLE", f""", x AS {_TITLES}, c AS (SELECT id, title, t, {_in('professor|lecturer')} AS f FROM x), k AS (SELECT r, n FROM (VALUES {', '.join(f"({i}, {_q(n)})" for i, n in enumerate(screens.RANKS) if i)}) v(r, n)),
b AS (SELECT id, arg_max(n, length(n)) AS label FROM c JOIN k ON contains(t, lower(n)) GROUP BY id)
SELECT c.id, CASE WHEN f THEN 'faculty' WHEN regexp_matches(t, '(^|[^a-z0-9_])emerit') THEN 'emeritus' WHEN {_in('dean')} THEN 'admin' WHEN regexp_matches(t, '(^|[^a-z0-9_])advis') THEN 'advisor' ELSE 'staff' END AS role,
CAST(CASE WHEN contains(t, 'department chair') THEN 0 ELSE coalesce((SELECT r FROM k WHERE n = b.label), CASE WHEN contains(t, 'dean') THEN 2 ELSE 7 END) END AS INTEGER) AS rank,
CASE WHEN contains(t, 'department chair') THEN 'Department Chair' ELSE coalesce(b.label, CASE WHEN contains(t, 'dean') THEN 'Professor' ELSE 'Faculty' END) END AS label FROM c LEFT JOIN b ON b.id = c.id"""),
    "a27_dispatch": _RUN + """ SELECT count(*) AS n, floor(count(*) FILTER (WHERE gf = tf) / count(*) * 1e6 + 0.5) / 1e6 AS family_accuracy,
  floor(count(*) FILTER (WHERE gf = 'KG' AND tf = 'KG' AND gs = ts) / nullif(count(*) FILTER (WHERE gf = 'KG' AND tf = 'KG'), 0) * 1e6 + 0.5) / 1e6 AS skill_accuracy,
  count(*) FILTER (WHERE gf = 'KG' AND tf IS DISTINCT FROM 'KG') AS structured_false_negative, count(*) FILTER (WHERE ts IN ('metric_of_person', 'link_of_person') AND NOT (gf = 'KG' AND gs <> 'entity_card')) AS false_honest_partial,
  count(*) FILTER (WHERE gf = 'KG' AND tf = 'KG' AND gs IS DISTINCT FROM ts) AS wrong_confident_exact FROM r""",
    "a27_dispatch_confusion": _RUN + " SELECT gs AS gold_skill, ts AS told_skill, count(*) AS n FROM r WHERE gf = 'KG' AND tf = 'KG' GROUP BY ALL",
    "a28_slot_scores": _SLOTS,
    "e24_evidence": duck("PEOPLE", f""", {_KEYWORD}, {_PLAIN}, {_PAIRS}, {_near(k=100)}, {_SAID},
ev AS (SELECT item_id, 'keyword' AS probe, 'item' AS kind, doc_id AS ref FROM kw WHERE place <= 20 UNION SELECT item_id, 'vector', 'item', doc_id FROM nn
  UNION SELECT item_id, said.kind, flat.kind, ref FROM said JOIN flat ON w <> '' AND contains(f, ' ' || w || ' ') AND (said.kind = 'phrase' OR flat.kind = 'node')),
fw AS (SELECT item_id, list_filter(ts, lambda t: t NOT IN ({_STOP})) AS fs FROM asked0),
sc AS (SELECT item_id, probe, ev.kind, ev.ref, CASE WHEN len(fs) > 0 THEN floor(len(list_intersect(fs, ws)) / len(fs) * 1e6 + 0.5) / 1e6 ELSE 0 END AS s FROM ev JOIN fw USING (item_id) JOIN span ON span.kind = ev.kind AND span.ref = ev.ref),
m AS (SELECT item_id, max(s) AS m FROM sc GROUP BY item_id),
k AS (SELECT item_id, array_to_string(list_sort(list_distinct(list(probe))), ',') AS probes, count(DISTINCT (kind, ref)) AS n FROM sc JOIN m USING (item_id) WHERE s >= CASE WHEN m >= 0.9 THEN 0.9 ELSE 0.5 END GROUP BY item_id)
SELECT b.item_id AS fact_id, coalesce(m, 0) >= 0.9 AS present, coalesce(m >= 0.5 AND m < 0.9, false) AS low_conf, coalesce(probes, '') AS probes, coalesce(n, 0) AS n_evidence, coalesce(m, 0) AS max_score
FROM (SELECT DISTINCT item_id FROM benchmark) b LEFT JOIN m USING (item_id) LEFT JOIN k USING (item_id)"""),
}
