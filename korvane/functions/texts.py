"""Text functions: tokens, names, corrections, matching, page parts, typed checks and dates."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korvane.operators.bindings import AREAS, ASK, FEEDBACK, PEOPLE, Q, SERIES
from korvane.operators.relational import ctes, r6

STOP = "'a', 'an', 'and', 'are', 'for', 'in', 'is', 'of', 'on', 'the', 'to', 'what', 'who', 'with', 'by', 'about'"
CONTENT = f"@filter(@rxall(lower(text), '([a-z]+)', 1), @lx length(x) > 1 AND x NOT IN ({STOP}))"
WORDS = "@filter(@rxall(lower(text), '([a-z]+)', 1), @lx length(x) > 1)"
#: Elements whose whole content is no visible text.
HIDDEN = ("script", "style", "nav", "header", "footer", "form")


def without_elements(column: str) -> str:
    """The page without hidden elements, comments, tags and runs of blanks."""
    for name in HIDDEN:
        column = f"regexp_replace({column}, '(?is)<{name}[^>]*>.*?</{name}>', ' '@g)"
    column = f"regexp_replace(regexp_replace({column}, '(?s)<!--.*?-->', ' '@g), '<[^>]*>', ' '@g)"
    return f"trim(regexp_replace(replace(replace(replace({column}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\r\n]+', ' '@g))"


DAY = "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]"
SITE = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
TURNS = "turns AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM {conversations})"
PROPER = "@distinct(@rxall({}, '([A-Z][a-z]+)', 1))"
#: Common words count a little, proper nouns in common count more.
BONUS = f"least(1e0, 5e-2 * @size(@both(@distinct(mine), @distinct(theirs))) + 15e-2 * @size(@both({PROPER.format('text')}, {PROPER.format('previous')})))"
NAMED = PEOPLE + ", named AS (SELECT *, lower(surname) AS skey FROM people)"

SQL: dict[str, str] = {
    "p03_plan_branches": "SELECT 'default' AS plan, doc_id FROM {documents} WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT 'whitelist' AS plan, doc_id FROM {documents} WHERE lang IN ('en') UNION ALL SELECT 'empty_exclusion' AS plan, doc_id FROM {documents}",
    "p12_url_segments": "SELECT page_id, CASE WHEN @has(parts, 'people') THEN 'skip' WHEN @has(parts, 'news') OR @has(parts, 'en') THEN 'news' WHEN @has(parts, 'events') OR @has(parts, 'fr') THEN 'event' WHEN @has(parts, 'policy') OR @has(parts, 'de') THEN 'policy' ELSE 'page' END AS kind FROM (SELECT page_id, @split(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '/') AS parts FROM {pages}) t",
    "x02_tokens": f"SELECT doc_id, @join({WORDS}, '|') AS tokens FROM {{documents}}",
    "x04_folded": "SELECT doc_id, @unaccent(lower(text)@folds) AS folded FROM {documents}",
    "x06_one_edit": "WITH vocab AS (SELECT DISTINCT word FROM (SELECT @explode(@rxall(lower(text), '([a-z]+)', 1)) AS word FROM {benchmark}) t WHERE length(word) > 3), asked AS (SELECT DISTINCT word FROM (SELECT @explode(@rxall(lower(text), '([a-z]+)', 1)) AS word FROM {conversations} WHERE role = 'user') t WHERE length(word) > 3), wrong AS (SELECT word FROM asked ANTI JOIN vocab USING (word)), vkeys AS (SELECT DISTINCT word, CASE WHEN i = 0 THEN word ELSE substr(word, 1, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) END AS k FROM (SELECT word, @explode(@range(0, CAST(length(word) AS INTEGER))) AS i FROM vocab) t), wkeys AS (SELECT DISTINCT word, CASE WHEN i = 0 THEN word ELSE substr(word, 1, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) END AS k FROM (SELECT word, @explode(@range(0, CAST(length(word) AS INTEGER))) AS i FROM wrong) t) SELECT w.word, min(v.word) AS correction FROM wkeys w JOIN vkeys v ON v.k = w.k WHERE levenshtein(w.word, v.word) = 1 GROUP BY w.word HAVING count(DISTINCT v.word) = 1",
    "x07_match_expression": f"SELECT item_id, @join(CASE WHEN @size(content) > 0 THEN content ELSE words END, ' OR ') AS expression FROM (SELECT item_id, {CONTENT} AS content, {WORDS} AS words FROM {{benchmark}}) t",
    "x08_expansion": "SELECT doc_id, CASE WHEN @rx(lower(text), '@b(ble|ing)@b') THEN text || ' expanded form' ELSE text END AS expanded FROM {documents}",
    "x09_phrase": f"SELECT doc_id FROM (SELECT doc_id, ' ' || @join({WORDS}, ' ') || ' ' AS padded FROM {{documents}}) t WHERE contains(padded, ' of the ') OR contains(padded, ' to the ')",
    "x13_keyword_bonus": f"WITH {TURNS} SELECT conv_id, turn, {r6(BONUS)} AS bonus "
    f"FROM (SELECT conv_id, turn, text, previous, {WORDS} AS mine, {WORDS.replace('text', 'previous')} AS theirs FROM turns WHERE previous IS NOT NULL) t",
    "x14_context": f"WITH last2 AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM {{conversations}} WHERE role = 'assistant'), w AS (SELECT conv_id, r, @explode(@range(1, CAST(@size({WORDS}) AS INTEGER))) AS i, {WORDS} AS ws FROM last2 WHERE r <= 2 AND @size({WORDS}) > 0), f AS (SELECT conv_id, word, min(r * 1000000 + i) AS pos FROM (SELECT conv_id, r, i, @at(ws, CAST(i AS INTEGER)) AS word FROM w) t WHERE length(word) >= 5 GROUP BY conv_id, word) SELECT conv_id, word, CAST(place AS BIGINT) AS place FROM (SELECT conv_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS place FROM f) t WHERE place <= 5",
    "x15_sigmoid": ctes(Q) + f"SELECT id, {r6('1e0 / (1e0 + exp(-(confidence - 5e1) / 1e1))')} AS chance, {r6('ln(1e0 + confidence)')} AS logged FROM q WHERE confidence IS NOT NULL",
    "x17_clean": "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9%$. ]', ' '@g), ' +', ' '@g)) AS cleaned FROM {documents}",
    "x18_visible_text": f"SELECT page_id, {without_elements('html')} AS visible FROM {{pages}}",
    "x19_structural_hash": f"SELECT page_id, @sha({without_elements('html')}@bits) AS structure FROM {{pages}}",
    "x20_links": f"SELECT DISTINCT page_id, CASE WHEN @rx(href, '^[a-z]+://') THEN href ELSE site || href END AS target FROM (SELECT page_id, {SITE} AS site, @explode(@rxall(html, 'href=\"([^\"#]*)', 1)) AS href FROM {{pages}}) t WHERE length(href) > 0 AND (NOT @rx(href, '^[a-z]+://') OR substr(href, 1, length(site)) = site)",
    "x22_page_dates": f"SELECT page_id, coalesce(nullif(regexp_extract(html, 'published_time\" content=\"({DAY})', 1), ''), nullif(regexp_extract(html, '\"datePublished\" *: *\"({DAY})', 1), ''), nullif(regexp_extract(html, '<time datetime=\"({DAY})', 1), ''), nullif(regexp_extract(html, '({DAY})', 1), '')) AS published FROM {{pages}}",
    "x23_area_list": "SELECT p_partkey, lower(trim(area)) AS area FROM (SELECT p_partkey, @explode(@rxall(p_type || ', ' || p_name || ' (' || p_brand || ', new); ' || p_type, '((?:[^,;(]|[(][^)]*[)])+)', 1)) AS area FROM {part}) t GROUP BY p_partkey, lower(trim(area))",
    # the question's own words say what is wanted: how many or how much a number, where to write an address
    "x26_answer_type": "SELECT conv_id, turn, wanted, @join(held, ',') AS held FROM (SELECT conv_id, turn, wanted, CASE WHEN wanted = 'number' THEN @rxall(text, '([0-9][0-9,.]*)', 1) ELSE @rxall(text, '([A-Za-z0-9._]+[@][A-Za-z0-9.-]+)', 1) END AS held "
    "FROM (SELECT conv_id, turn, text, CASE WHEN @rx(text, '[@]') THEN 'mail' WHEN @rx(text, '[0-9]') THEN 'number' END AS wanted FROM {conversations}) w WHERE wanted IS NOT NULL) t WHERE @size(held) > 0",
    "x28_supported": f"WITH {TURNS} SELECT conv_id, turn, {r6('1e0 * @size(@filter(mine, @lx @has(theirs, x))) / @size(mine)')} AS ratio, 1e0 * @size(@filter(mine, @lx @has(theirs, x))) / @size(mine) >= 6e-1 AS supported FROM (SELECT conv_id, turn, @distinct({CONTENT}) AS mine, {CONTENT.replace('text', 'previous')} AS theirs FROM turns WHERE previous IS NOT NULL) t WHERE @size(mine) > 0",
    "x29_typed_checks": "SELECT doc_id, @has(@map(@rxall(text, '([0-9][0-9,]*)', 1), @lx replace(x, ',', '')), CAST(n_chars % 100 AS STRING)) AS number_found, @has(@map(@rxall(text, '([A-Za-z0-9._]+[@][A-Za-z0-9.-]+[A-Za-z0-9])', 1), @lx lower(x)), 'nobody' || chr(64) || 'example.com') AS mail_found FROM {documents}",
    # no answer is right where nothing was asked for; a low answer that users rejected was made up; a known person left unresolved
    "x30_failure_class": ctes(Q, FEEDBACK)
    + ", down AS (SELECT user_id, k FROM fb WHERE rating = 'thumbs_down' GROUP BY user_id, k), known AS (SELECT s_suppkey AS k FROM {supplier}) "
    "SELECT q.id, CASE WHEN confidence IS NULL AND topic IS NULL THEN 'pass' WHEN confidence IS NULL AND n.k IS NOT NULL THEN 'resolution_failure' WHEN confidence IS NULL THEN 'routing_failure' "
    "WHEN confidence >= 50 AND d.k IS NULL THEN 'pass' WHEN d.k IS NOT NULL THEN 'fabrication' WHEN n.k IS NOT NULL THEN 'resolution_failure' ELSE 'routing_failure' END AS verdict "
    "FROM q LEFT JOIN down d ON d.user_id = q.user_id AND d.k = q.k LEFT JOIN known n ON n.k = q.k",
    "x31_masked": "SELECT doc_id, regexp_replace(lower(text), '@b(of the|the|ing)@b', '[slot]'@g) AS masked FROM {documents}",
    "x32_template": ctes(PEOPLE) + "SELECT id, replace(replace('Dear ' || chr(123) || 'name' || chr(125) || ', ' || chr(123) || 'title' || chr(125) || ' ' || chr(123) || 'other' || chr(125), chr(123) || 'name' || chr(125), shown), chr(123) || 'title' || chr(125), title) AS message FROM people",
    "x33_aliases": ctes(PEOPLE, Q, ASK) + "SELECT id, metric FROM (SELECT a.id, m.metric, row_number() OVER (PARTITION BY a.id ORDER BY length(m.alias) DESC, m.alias) AS r FROM ask a JOIN (SELECT 'papers' AS alias, 'works' AS metric UNION ALL SELECT 'papers by', 'authored' UNION ALL SELECT 'who', 'person' UNION ALL SELECT 'what about', 'topic') m ON contains(' ' || a.text || ' ', ' ' || m.alias || ' ')) t WHERE r = 1",
    "x34_top_n": ctes(Q) + "SELECT id, try_cast(nullif(regexp_extract(said, 'top ([0-9]+)', 1), '') AS BIGINT) AS top_n, CASE WHEN @rx(said, '@b(first|1st)@b') THEN CAST(1 AS BIGINT) WHEN @rx(said, '@b(second|2nd)@b') THEN CAST(2 AS BIGINT) WHEN @rx(said, '@b(last)@b') THEN CAST(-1 AS BIGINT) END AS pick FROM (SELECT id, CASE k % 4 WHEN 0 THEN 'top ' || CAST(k AS STRING) || ' people' WHEN 1 THEN 'the first one' WHEN 2 THEN 'the last' ELSE 'tell me' END AS said FROM q) t",
    "x35_rewrite_guard": f"WITH {TURNS} SELECT conv_id, turn, length(text) <= 3 * length(previous) AS short_enough, @size(@filter({CONTENT}, @lx NOT @has(theirs, x))) = 0 AS nothing_added FROM (SELECT conv_id, turn, text, previous, {WORDS.replace('text', 'previous')} AS theirs FROM turns WHERE previous IS NOT NULL) t",
    "x36_sparkline": ctes(SERIES) + "SELECT id, @join(@sort(@list(CAST(10 * (y - 1990) + 100 AS STRING) || ',' || CAST(n AS STRING))), ' ') AS points FROM yearly GROUP BY id",
    # dates
    "d01_tolerant": "SELECT o_orderkey, CAST(coalesce(try_cast(said AS DATE), try_cast(said || '-01' AS DATE)) AS STRING) AS parsed FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) ELSE 'soon' END AS said FROM {orders}) t",
    "d02_recurrence": "SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate + INTERVAL 1 DAY AS DATE) WHEN 1 THEN CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) WHEN 2 THEN CASE dow WHEN 0 THEN CAST(o_orderdate + INTERVAL 2 DAY AS DATE) WHEN 1 THEN CAST(o_orderdate + INTERVAL 1 DAY AS DATE) WHEN 2 THEN CAST(o_orderdate + INTERVAL 2 DAY AS DATE) WHEN 3 THEN CAST(o_orderdate + INTERVAL 1 DAY AS DATE) WHEN 4 THEN CAST(o_orderdate + INTERVAL 3 DAY AS DATE) WHEN 5 THEN CAST(o_orderdate + INTERVAL 2 DAY AS DATE) ELSE CAST(o_orderdate + INTERVAL 1 DAY AS DATE) END END AS STRING) AS next_day FROM (SELECT o_orderkey, o_orderdate, (CAST(floor(@epoch(o_orderdate) / 864e2) AS BIGINT) + 3) % 7 AS dow FROM {orders}) t",
    "d03_event_time": "SELECT id, CASE WHEN said = 'TBD' THEN CAST(540 AS BIGINT) ELSE 60 * (CAST(regexp_extract(said, '^([0-9]+)', 1) AS BIGINT) % CASE WHEN @rx(said, 'M$') THEN 12 ELSE 24 END + CASE WHEN @rx(said, 'PM$') THEN 12 ELSE 0 END) + CAST(regexp_extract(said, ':([0-9]+)', 1) AS BIGINT) END AS minute_of_day FROM (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '7:30 PM' WHEN 1 THEN '14:05' WHEN 2 THEN '12:15 AM' ELSE 'TBD' END AS said FROM {events}) t",
    "d10_auto_delete": "SELECT event_id, CAST(greatest(1, least(48, coalesce(try_cast(said AS INTEGER), 24))) AS BIGINT) AS hours FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'never' ELSE CAST(event_id % 90 - 10 AS STRING) END AS said FROM {events}) t",
    # binding and classification of questions
    "n04_org_candidates": "WITH named AS (SELECT n_nationkey AS id, lower(n_name) || ' (' || upper(substr(n_name, 1, 3)) || CAST(n_nationkey AS STRING) || ')' AS name FROM {nation}) SELECT id, phrase FROM (SELECT id, name AS phrase FROM named UNION SELECT id, replace(name, ' ', '-') FROM named UNION SELECT id, trim(regexp_replace(name, '[(][^)]*[)]', ''@g)) FROM named UNION SELECT id, lower(acronym) FROM (SELECT id, @explode(@rxall(name, '[(]([A-Z0-9]+)[)]', 1)) AS acronym FROM named) t WHERE length(acronym) >= 3) u WHERE phrase <> ''",
    "n05_topic_span": ctes(PEOPLE, Q, ASK) + "SELECT id, topic FROM (SELECT id, trim(regexp_extract(text, '(?:papers by|what about) (.+)$', 1)) AS topic FROM ask) t WHERE topic <> '' AND @size(@split(topic, ' ')) <= 4 AND topic IN (SELECT lower(given) FROM people UNION SELECT lower(surname) FROM people)",
    "n06_surname_binding": ctes(NAMED, Q, ASK) + ", held AS (SELECT skey, count(*) AS n, min(id) AS person FROM named GROUP BY skey), words AS (SELECT id, @split(text, ' ') AS ws FROM ask), hits AS (SELECT w.id, h.n, h.person, row_number() OVER (PARTITION BY w.id ORDER BY w.pos) AS r FROM (SELECT id, i AS pos, @at(ws, CAST(i AS INTEGER)) AS word FROM (SELECT id, ws, @explode(@range(1, CAST(@size(ws) AS INTEGER))) AS i FROM words) t) w JOIN held h ON h.skey = w.word) SELECT id, CASE WHEN n = 1 THEN person END AS person, n >= 2 AS ambiguous FROM hits WHERE r = 1",
    "n07_full_name": ctes(NAMED, Q, ASK) + ", firsts AS (SELECT skey, lower(given) AS gkey, count(*) AS people, min(id) AS person FROM named GROUP BY skey, lower(given)), words AS (SELECT DISTINCT id, @explode(@split(text, ' ')) AS word FROM ask) SELECT a.id, f.person, f.people FROM words a JOIN firsts f ON f.skey = a.word JOIN words b ON b.id = a.id AND b.word = f.gkey",
    "n08_route": ctes(PEOPLE, Q, ASK) + "SELECT id, CASE WHEN @rx(text, '^who is [a-z]+ [a-z]+$') THEN 'person' WHEN @rx(text, '^papers by ') THEN 'works' WHEN @rx(text, '^what about ') THEN 'topic' ELSE 'free_text' END AS route FROM ask",
    "n09_role_lookup": ctes(PEOPLE) + "SELECT DISTINCT id, trim(part) AS role FROM (SELECT id, @explode(@split(replace(title, ' and ', ','), ',')) AS part FROM people) t WHERE @rx(part, '^ *(Dean|Distinguished)')",
    "n15_identity_only": ctes(PEOPLE, Q, ASK) + f"SELECT a.id, @size(@filter(@split(a.text, ' '), @lx NOT @has(@split(a.person_name, ' '), x) AND x NOT IN ({STOP}))) = 0 AS identity_only FROM ask a",
    # an office answers for the topics that have one; else the ladder goes down by confidence
    "n18_tier_ladder": ctes(Q)
    + ", office AS (SELECT DISTINCT lower(event_type) AS topic FROM {events} WHERE event_type IN ('purchase', 'signup')) "
    "SELECT q.id, CASE WHEN confidence >= 60 THEN 'primary' WHEN o.topic IS NOT NULL AND confidence >= 30 THEN 'office' WHEN confidence >= 10 THEN 'deep' ELSE 'live' END AS tier "
    "FROM q LEFT JOIN office o ON o.topic = q.topic",
    # turns that name a person of the benchmark; where a conversation has any, only these stay, and where it has none it abstains
    "n19_person_scope": f"WITH names AS (SELECT DISTINCT @at({WORDS}, 1) AS name FROM {{benchmark}} WHERE @size({WORDS}) > 0), "
    f"said AS (SELECT conv_id, turn, @explode(@distinct({WORDS})) AS word FROM {{conversations}}), hit AS (SELECT DISTINCT conv_id, turn FROM said WHERE word IN (SELECT name FROM names)), "
    "scoped AS (SELECT DISTINCT conv_id FROM hit) "
    "SELECT c.conv_id, c.turn, s.conv_id IS NULL AS abstain FROM {conversations} c LEFT JOIN scoped s ON s.conv_id = c.conv_id LEFT JOIN hit h ON h.conv_id = c.conv_id AND h.turn = c.turn "
    "WHERE s.conv_id IS NULL OR h.turn IS NOT NULL",
    "n20_context_budget": "SELECT conv_id, turn, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) ELSE text END AS kept FROM (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS so_far, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {conversations}) t WHERE so_far <= 2000 OR r = 1",
    "n21_addendum": ctes(AREAS) + "SELECT person_id, @join(@sort(@list(tag)), '; ') || CASE WHEN max(n) > 3 THEN ' +' || CAST(max(n) - 3 AS STRING) || ' more' ELSE '' END AS line FROM (SELECT person_id, tag, row_number() OVER (PARTITION BY person_id ORDER BY tag) AS r, count(*) OVER (PARTITION BY person_id) AS n FROM (SELECT DISTINCT person_id, tag FROM tagged) a) t WHERE r <= 3 GROUP BY person_id",
    "n22_facts_preserved": f"WITH {TURNS} SELECT conv_id, turn, @size(@filter(@rxall(previous, '([0-9][0-9][0-9]+)', 1), @lx NOT contains(text, x))) = 0 AND @size(@filter(@rxall(previous, '([A-Za-z0-9._]+[@][A-Za-z0-9.-]+)', 1), @lx NOT contains(text, x))) = 0 AS preserved FROM turns WHERE previous IS NOT NULL",
}


def context_words(turns: DataFrame, most: int = 5) -> DataFrame:
    """conv_id, word, place: the first distinct words of five letters and more in the last two answers of a conversation, the last answer first.

    turns: conv_id, turn, role, text. Words are runs of two and more letters a-z. A text's words are split once and only its first ``most`` leave
    it, since no later one of a text can be among the first of both.
    """
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.length(w) > 1)
    long = lambda ws: F.slice(F.array_distinct(F.filter(ws, lambda w: F.length(w) >= 5)), 1, most)
    # an array of one entry holds the words, so that they are split once
    first = F.transform(F.array(words), lambda ws: F.transform(long(ws), lambda w: F.struct(F.array_position(ws, w).alias("at"), w.alias("word"))))[0]
    rows = turns.where("role = 'assistant'").select("conv_id", "turn", first.alias("held"))
    own = Window.partitionBy("conv_id")
    last = rows.withColumn("r", F.row_number().over(own.orderBy(F.desc("turn")))).where("r <= 2")
    each = last.select("conv_id", "r", F.explode("held").alias("x"))
    met = each.groupBy("conv_id", F.col("x.word").alias("word")).agg(F.min(F.col("r") * 1000000 + F.col("x.at")).alias("pos"))
    placed = met.withColumn("place", F.row_number().over(own.orderBy("pos")).cast("long"))
    return placed.where(F.col("place") <= most).select("conv_id", "word", "place")
