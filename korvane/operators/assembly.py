"""Assembly of profiles and rosters, reconciliation, evaluation and acceptance reports."""

from korvane.operators.bindings import AREAS, DOCS, FEEDBACK, ORG, PEOPLE, POSTS, Q, SCORES, SERIES, VERSIONS
from korvane.operators.relational import ctes, r6

TOKENS = "@distinct(@filter(@rxall(lower(text), '([a-z]+)', 1), @lx length(x) > 1))"
CRITERIA = "criteria AS (SELECT l_suppkey AS number, l_orderkey AS judge_id, c.criterion, CASE c.criterion WHEN 'clarity' THEN l_quantity WHEN 'depth' THEN l_discount * 1e2 ELSE l_tax * 1e2 END AS points FROM {lineitem} CROSS JOIN (SELECT 'clarity' AS criterion UNION ALL SELECT 'depth' UNION ALL SELECT 'style') c)"
GOLD = "gold AS (SELECT doc_id AS id, 'toxic' AS slot FROM {labels} WHERE toxic = 1 UNION SELECT doc_id, 'good' FROM {labels} WHERE quality = 1), pred AS (SELECT doc_id AS id, 'toxic' AS slot FROM {documents} WHERE @rx(lower(text), '@b(hate|idiot|stupid)@b') UNION SELECT doc_id, 'good' FROM {documents} WHERE n_chars > 400)"
DRAWS, MOD = 2000, 1000003
SLOPES = SERIES + """, win AS (SELECT id, y, n, count(*) OVER (PARTITION BY id) AS years FROM yearly WHERE y BETWEEN 1996 AND 2000),
slopes AS (SELECT a.id, (ln(1e0 + b.n) - ln(1e0 + a.n)) / (b.y - a.y) AS s FROM win a JOIN win b ON b.id = a.id AND b.y > a.y WHERE a.years = 5),
placed AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY s) AS r FROM slopes),
trend AS (SELECT id, median(s) AS slope, min(CASE WHEN r = 3 THEN s END) AS p25 FROM placed GROUP BY id),
base AS (SELECT id, median(n) AS typical, max(CASE WHEN y = 2000 THEN n END) AS latest FROM win WHERE years = 5 GROUP BY id)"""


def pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {r6(f'1e0 * {a} / {b}')} END"


SQL: dict[str, str] = {
    # sources and checksums
    "s02_snapshot_checksum": "SELECT bucket, count(*) AS n, @sha(@join(@sort(@list(h)), '')@bits) AS digest FROM (SELECT CAST(floor(doc_id / 1e3) AS BIGINT) AS bucket, @sha(CAST(doc_id AS STRING) || chr(1) || coalesce(text, chr(0))@bits) AS h FROM {documents}) t GROUP BY bucket",
    "s03_safe_urls": "SELECT page_id, @rx(url, '^https?://') AND NOT @rx(url, '^https?://(localhost|127[.]|10[.]|192[.]168[.]|169[.]254[.])') AND length(html) <= 2000000 AS safe FROM {pages}",
    "s05_sitemap": "SELECT DISTINCT loc FROM (SELECT @explode(@rxall(xml, '<loc>([^<]*)</loc>', 1)) AS loc FROM (SELECT '<url><loc>' || url || '</loc></url>' AS xml FROM {pages}) a) t",
    "s06_quality_class": "SELECT doc_id, CASE WHEN length(text) < 50 THEN 'scanned' WHEN @size(@rxall(text, '([$][0-9])', 1)) >= 3 THEN 'tables' WHEN length(text) >= 500 THEN 'text' ELSE 'thin' END AS class FROM {documents}",
    "s08_csv_rows": "SELECT row_id, @at(cells, 2) AS name, amount FROM (SELECT row_id, cells, try_cast(@at(cells, 3) AS BIGINT) AS amount FROM (SELECT s_suppkey AS row_id, @split(CAST(s_suppkey AS STRING) || ',' || s_name || ',' || CASE WHEN s_suppkey % 9 = 0 THEN 'bad' ELSE CAST(s_nationkey AS STRING) END, ',') AS cells FROM {supplier}) a) t WHERE amount IS NOT NULL",
    "s09_json_feed": "SELECT event_id, CAST(@json(feed, '$.home.score') AS BIGINT) AS home, @json(feed, '$.state') AS state FROM (SELECT event_id, chr(123) || '\"state\":\"' || event_type || '\",\"home\":' || chr(123) || '\"score\":' || @json(props, '$.k') || chr(125) || chr(125) AS feed FROM {events}) t",
    "s10_jsonl_faults": ctes(Q) + "SELECT id, CASE WHEN question IS NULL THEN 'no_query' WHEN mode NOT IN ('view', 'click', 'purchase', 'signup') THEN 'bad_family' WHEN copies > 1 AND topic IS NULL THEN 'repeated' END AS fault FROM (SELECT *, count(*) OVER (PARTITION BY user_id, question) AS copies FROM q) t WHERE question IS NULL OR mode NOT IN ('view', 'click', 'purchase', 'signup') OR (copies > 1 AND topic IS NULL)",
    "s16_missing_vectors": "SELECT d.doc_id FROM {documents} d LEFT SEMI JOIN {labels} l ON l.doc_id = d.doc_id ANTI JOIN {embeddings} e ON e.vec_id = d.doc_id".replace("LEFT SEMI", "SEMI"),
    # joins
    "j03_in_subquery": ctes(PEOPLE) + "SELECT id, slug FROM people WHERE id IN (SELECT l_suppkey FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity > 40)",
    "j11_parent_chain": ctes(ORG) + "SELECT c.id, p.name AS parent, g.name AS grandparent FROM org c LEFT JOIN org p ON p.id = c.parent_id LEFT JOIN org g ON g.id = p.parent_id",
    # organisations of one source by the slugs of another; those without a counterpart stay, unmapped
    "j12_slug_map": ctes(ORG)
    + ", other AS (SELECT n_nationkey AS key, lower(replace(n_name, ' ', '-')) AS slug FROM {nation} WHERE n_regionkey <> 2) "
    "SELECT o.id, r.key FROM org o LEFT JOIN other r ON r.slug = lower(replace(o.name, ' ', '-'))",
    # aggregations
    "a14_canonical_form": ctes(AREAS) + "SELECT folded, tag AS canonical FROM (SELECT folded, tag, row_number() OVER (PARTITION BY folded ORDER BY n DESC, tag) AS r FROM (SELECT lower(tag) AS folded, tag, count(*) AS n FROM tagged GROUP BY lower(tag), tag) a) t WHERE r = 1",
    "a19_low_coverage": ctes(SCORES) + f"SELECT p.number, {r6('avg(s.final_score)')} AS mean, count(s.number) AS n, count(s.number) < 3 AS low_coverage FROM presenter p LEFT JOIN score s ON s.number = p.number GROUP BY p.number",
    "a20_criteria": ctes(CRITERIA) + f"SELECT number, criterion, {r6('avg(points)')} AS mean, count(*) AS n FROM criteria GROUP BY number, criterion",
    "a26_nearest_rank": ctes(Q) + "SELECT mode, confidence AS p90 FROM (SELECT mode, confidence, row_number() OVER (PARTITION BY mode ORDER BY confidence) AS r, count(*) OVER (PARTITION BY mode) AS n FROM q WHERE confidence IS NOT NULL) t WHERE r = 1 + CAST(@bround(9e-1 * (n - 1), 0) AS BIGINT)",
    "a28_micro_f1": ctes(GOLD) + f"SELECT tp, fp, fn, {pct('tp', '(tp + fp)')} AS micro_precision, {pct('tp', '(tp + fn)')} AS micro_recall, {pct('2 * tp', '(2 * tp + fp + fn)')} AS f1 FROM (SELECT count_if(g.id IS NOT NULL AND p.id IS NOT NULL) AS tp, count_if(g.id IS NULL) AS fp, count_if(p.id IS NULL) AS fn FROM gold g FULL OUTER JOIN pred p ON p.id = g.id AND p.slot = g.slot) t",
    "a31_bootstrap": ctes(Q) + f", clusters AS (SELECT user_id, count(*) AS n, count_if(confidence >= 50) AS good FROM q GROUP BY user_id), draws AS (SELECT draw, n, good, (((user_id % {MOD}) * 7919 + draw * 104729) % {MOD} * 48271 % 2147483647) / 2147483647e0 AS u FROM clusters CROSS JOIN (SELECT @explode(@range(1, {DRAWS})) AS draw) d), weighted AS (SELECT draw, n, good, CASE WHEN u < 367879e-6 THEN 0 WHEN u < 735759e-6 THEN 1 WHEN u < 919699e-6 THEN 2 WHEN u < 981012e-6 THEN 3 WHEN u < 996340e-6 THEN 4 WHEN u < 999406e-6 THEN 5 WHEN u < 999917e-6 THEN 6 ELSE 7 END AS w FROM draws), rates AS (SELECT draw, 1e0 * sum(w * good) / sum(w * n) AS rate FROM weighted GROUP BY draw) SELECT {r6('min(CASE WHEN r = 51 THEN rate END)')} AS low, {r6('min(CASE WHEN r = 1950 THEN rate END)')} AS high FROM (SELECT rate, row_number() OVER (ORDER BY rate) AS r FROM rates WHERE rate IS NOT NULL) t",
    "a32_sample_size": ctes(Q) + f"SELECT mode, n, CAST(ceil(38416e-4 * p * (1 - p) / 25e-4) AS BIGINT) AS needed, {r6('pt - 196e-2 * sqrt(pt * (1 - pt) / (n + 38416e-4))')} AS low, {r6('pt + 196e-2 * sqrt(pt * (1 - pt) / (n + 38416e-4))')} AS high FROM (SELECT mode, n, 1e0 * good / n AS p, (good + 19208e-4) / (n + 38416e-4) AS pt FROM (SELECT mode, count(*) AS n, count_if(confidence >= 50) AS good FROM q GROUP BY mode) a) t",
    "a33_rollup_delta": ctes(Q) + "SELECT mode, count_if(run = 1) AS now_n, count_if(run = 1 AND confidence >= 50) AS now_good, count_if(run = 1 AND confidence >= 50) - count_if(run = 0 AND confidence >= 50) AS delta FROM (SELECT mode, confidence, CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 0 END AS run FROM q) t GROUP BY mode",
    "a36_group_concat": ctes(ORG) + "SELECT parent_id, @join(@sort(@list(name)), ', ') AS names FROM org WHERE parent_id IS NOT NULL GROUP BY parent_id",
    # ranks and sets
    "w03_sequence": ctes(PEOPLE) + "SELECT id, row_number() OVER (ORDER BY metric DESC, id) AS place FROM people",
    "w15_rising": ctes(SLOPES) + f"SELECT t.id, CAST(@bround((exp(slope) - 1) * 1e2, 0) AS BIGINT) AS pct, latest < 25 OR @bround((exp(slope) - 1) * 1e2, 0) < 1 AS glyph FROM trend t JOIN base b ON b.id = t.id WHERE typical >= 10 AND slope > 1e-9 AND p25 >= -1e-12",
    "w19_version_chain": "SELECT o_custkey AS root_id, o_orderkey, place, last_key FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS last_key FROM {orders}) t",
    "t07_page": ctes(POSTS) + "SELECT id, kind FROM post ORDER BY id DESC LIMIT 25 OFFSET 50",
    "t10_least_tested": ctes(Q) + "SELECT question, count(*) AS n FROM q GROUP BY question ORDER BY n, question LIMIT 20",
    "t11_longest_match": f"WITH phrases AS (SELECT DISTINCT phrase FROM (SELECT @at(ts, 1) AS phrase FROM (SELECT @rxall(lower(text), '([a-z]+)', 1) AS ts FROM {{benchmark}}) a WHERE @size(ts) > 1 UNION ALL SELECT @at(ts, 1) || ' ' || @at(ts, 2) FROM (SELECT @rxall(lower(text), '([a-z]+)', 1) AS ts FROM {{benchmark}}) a WHERE @size(ts) > 1) u), words AS (SELECT conv_id, turn, @rxall(lower(text), '([a-z]+)', 1) AS ts FROM {{conversations}}), places AS (SELECT conv_id, turn, ts, @explode(@range(1, CAST(@size(ts) AS INTEGER))) AS i FROM words WHERE @size(ts) > 0), grams AS (SELECT conv_id, turn, @at(ts, CAST(i AS INTEGER)) AS gram FROM places UNION SELECT conv_id, turn, @at(ts, CAST(i AS INTEGER)) || ' ' || @at(ts, CAST(i + 1 AS INTEGER)) FROM places WHERE i < @size(ts)) SELECT conv_id, turn, phrase FROM (SELECT g.conv_id, g.turn, p.phrase, row_number() OVER (PARTITION BY g.conv_id, g.turn ORDER BY length(p.phrase) DESC, p.phrase) AS r FROM grams g JOIN phrases p ON p.phrase = g.gram) t WHERE r = 1",
    "u01_entity_union": ctes(PEOPLE) + "SELECT slug FROM people WHERE category = 'faculty' UNION SELECT 's/' || CAST(l_suppkey AS STRING) FROM {lineitem} WHERE l_returnflag = 'A'",
    "u02_annotated_union": ctes(AREAS) + "SELECT person_id, CASE WHEN min(precedence) = 0 THEN 'exact' ELSE 'expanded' END AS hit FROM (SELECT person_id, 0 AS precedence FROM tagged WHERE lower(tag) LIKE 'economy%' UNION ALL SELECT person_id, 1 FROM tagged WHERE lower(tag) LIKE '%ring') t GROUP BY person_id",
    "u03_stale_derived": ctes(VERSIONS) + "SELECT natural_key FROM prev EXCEPT SELECT natural_key FROM fresh",
    "u07_cross_run": "WITH known AS (SELECT DISTINCT md5(text) AS h FROM {documents} WHERE source = 'src1') SELECT doc_id FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS r FROM (SELECT doc_id, md5(text) AS h FROM {documents} WHERE source <> 'src1') a) t ANTI JOIN known k ON k.h = t.h WHERE r = 1",
    "u10_recurring_assets": "WITH assets AS (SELECT DISTINCT site, page_id, asset FROM (SELECT regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z]+)', 1) AS site, page_id, @explode(@rxall(html, '(<[a-z0-9]+ class=\"[^\"]*\">)', 1)) AS asset FROM {pages}) t), held AS (SELECT site, count(DISTINCT page_id) AS n FROM assets GROUP BY site) SELECT a.site, a.asset, count(*) AS pages FROM assets a JOIN held h ON h.site = a.site WHERE h.n >= 5 GROUP BY a.site, a.asset HAVING count(*) >= max(h.n) - 1",
    "u12_subset": ctes(PEOPLE) + ", kb AS (SELECT org_id, @distinct(@list(title)) AS titles FROM people WHERE category = 'joint' GROUP BY org_id), dept AS (SELECT org_id, @distinct(@list(title)) AS titles FROM people GROUP BY org_id) SELECT d.org_id, coalesce(@size(@filter(k.titles, @lx NOT @has(d.titles, x))), 0) = 0 AS kb_in_dept, coalesce(@size(@filter(d.titles, @lx NOT @has(k.titles, x))), 1) = 0 AS dept_in_kb FROM dept d LEFT JOIN kb k ON k.org_id = d.org_id",
    "u13_suppressed_areas": ctes(AREAS) + ", mine AS (SELECT DISTINCT person_id, tag FROM (SELECT person_id, lower(tag) AS tag FROM tagged UNION ALL SELECT person_id, @at(@split(lower(tag), ' '), 1) FROM tagged) t) SELECT DISTINCT a.person_id, a.tag FROM mine a JOIN mine b ON b.person_id = a.person_id AND b.tag <> a.tag WHERE @size(@filter(@split(a.tag, ' '), @lx NOT @has(@split(b.tag, ' '), x))) = 0",
    # hierarchy
    "h06_indented": "WITH RECURSIVE " + ORG + ", tree(id, shown, depth) AS (SELECT id, name AS shown, 0 AS depth FROM org WHERE parent_id IS NULL UNION ALL SELECT o.id, repeat('  ', t.depth + 1) || o.name, t.depth + 1 FROM tree t JOIN org o ON o.parent_id = t.id) SELECT id, shown, CAST(depth AS BIGINT) AS depth FROM tree",
    "h09_structural_pick": ctes(PEOPLE) + "SELECT org_id, lower(surname) AS surname, min(id) AS id FROM people GROUP BY org_id, lower(surname) HAVING count(*) = 1",
    # edges of the tree against the edges that the graph holds (those of organisations with people)
    "h10_part_of": ctes(ORG, PEOPLE)
    + ", held AS (SELECT DISTINCT o.id, o.parent_id FROM org o JOIN people p ON p.org_id = o.id) "
    "SELECT 'org/' || CAST(o.id AS STRING) AS src, 'org/' || CAST(o.parent_id AS STRING) AS dst, CASE WHEN h.id IS NOT NULL THEN 'keep' ELSE 'insert' END AS action "
    "FROM org o LEFT JOIN held h ON h.id = o.id AND h.parent_id = o.parent_id WHERE o.parent_id IS NOT NULL",
    "h14_home": "SELECT l_suppkey AS person_id, org_id FROM (SELECT l_suppkey, 100 + l_partkey % 25 AS org_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END, CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END, l_orderkey, l_linenumber) AS r FROM {lineitem}) t WHERE r = 1",
    # reconciliation
    "e01_decompose": ctes(PEOPLE) + "SELECT slug || ':' || k.kind AS natural_key, CASE k.kind WHEN 'title' THEN title WHEN 'name' THEN shown ELSE CAST(org_id AS STRING) END AS content FROM people CROSS JOIN (SELECT 'title' AS kind UNION ALL SELECT 'name' UNION ALL SELECT 'org') k",
    # prose of good quality outranks other prose, then the longer text wins
    "e03_keep_better": "WITH good AS (SELECT doc_id, max(quality) AS solid FROM {labels} GROUP BY doc_id), "
    "old AS (SELECT doc_id, length(text) AS words, 0 AS solid FROM {documents} WHERE source <> 'src3'), new AS (SELECT d.doc_id, length(trim(text)) AS words, coalesce(solid, 0) AS solid FROM {documents} d LEFT JOIN good g ON g.doc_id = d.doc_id) "
    "SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'inserted' WHEN n.words = o.words AND n.solid = o.solid THEN 'unchanged' WHEN n.solid > o.solid OR (n.solid = o.solid AND n.words > o.words) THEN 'updated' ELSE 'skipped_worse' END AS action "
    "FROM new n LEFT JOIN old o ON o.doc_id = n.doc_id",
    "e04_page_upsert": "WITH old AS (SELECT url, max(md5(html)) AS h FROM {pages} WHERE url NOT LIKE '%/fr/%' GROUP BY url), new AS (SELECT url, max(md5(CASE WHEN page_id % 5 = 0 THEN html || ' ' ELSE html END)) AS h FROM {pages} GROUP BY url) SELECT n.url, CASE WHEN o.url IS NULL THEN 'inserted' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS action FROM new n LEFT JOIN old o ON o.url = n.url",
    "e05_node_upsert": ctes(PEOPLE) + ", incoming AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Fellow' END AS title, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 END AS metric FROM {supplier}) SELECT p.id, @join(@sort(@distinct(@filter(@cat(array(p.title), array(i.title)), @lx x IS NOT NULL))), '; ') AS titles, coalesce(i.metric, p.metric) AS metric FROM people p LEFT JOIN incoming i ON i.id = p.id".replace("array(", "@array("),
    "e06_scoped_retire": ctes(VERSIONS) + "SELECT p.natural_key FROM prev p ANTI JOIN fresh f ON f.natural_key = p.natural_key JOIN {documents} d ON d.doc_id = p.natural_key AND d.source <> 'src1'",
    "e07_departures": ctes(PEOPLE) + ", listed AS (SELECT DISTINCT l_suppkey AS id FROM {lineitem} WHERE l_discount = 0 AND l_quantity = 50), touched AS (SELECT DISTINCT p.org_id FROM people p JOIN listed l ON l.id = p.id) SELECT p.id, p.org_id FROM people p SEMI JOIN touched t ON t.org_id = p.org_id ANTI JOIN listed l ON l.id = p.id",
    "e08_retire_or_refile": ctes(PEOPLE) + ", seen AS (SELECT l_suppkey AS id, max(100 + l_partkey % 25) AS org_id FROM {lineitem} WHERE l_quantity > 48 GROUP BY l_suppkey) SELECT p.id, CASE WHEN s.id IS NULL THEN 'retire' WHEN s.org_id <> p.org_id THEN 'refile' ELSE 'stay' END AS action FROM people p LEFT JOIN seen s ON s.id = p.id",
    "e12_invariants": "SELECT 'orphan_vector' AS fault, count(*) AS n FROM {embeddings} e ANTI JOIN {documents} d ON d.doc_id = e.vec_id UNION ALL SELECT 'missing_vector', count(*) FROM {documents} d ANTI JOIN {embeddings} e ON e.vec_id = d.doc_id UNION ALL SELECT 'repeated_vector', count(*) FROM (SELECT vec_id FROM {embeddings} GROUP BY vec_id HAVING count(*) > 1) r UNION ALL SELECT 'wrong_width', count(*) FROM {embeddings} WHERE @size(embedding) <> (SELECT max(@size(embedding)) FROM {embeddings}) UNION ALL SELECT 'empty_text', count(*) FROM {documents} WHERE coalesce(text, '') = ''",
    "e13_event_documents": ctes(POSTS) + "SELECT p.id, CASE WHEN d.doc_id IS NULL AND p.status = 'O' THEN 'create' WHEN d.doc_id IS NULL THEN 'none' WHEN p.status = 'F' THEN 'deactivate' ELSE 'update' END AS action FROM post p LEFT JOIN {documents} d ON d.doc_id = p.id",
    "e14_alignment": ctes(ORG, PEOPLE) + "SELECT 'unknown_org' AS fault, count(*) AS n FROM people p ANTI JOIN org o ON o.id = p.org_id UNION ALL SELECT 'untitled', count(*) FROM people WHERE title IS NULL UNION ALL SELECT 'wrong_parent', count(*) FROM org c JOIN org p ON p.id = c.parent_id WHERE c.type = 'department' AND p.type <> 'college'",
    "e15_acceptance": "SELECT 'orders_without_customer' AS fault, count(*) AS n FROM {orders} ANTI JOIN {customer} ON c_custkey = o_custkey UNION ALL SELECT 'lines_without_order', count(*) FROM {lineitem} ANTI JOIN {orders} ON o_orderkey = l_orderkey UNION ALL SELECT 'bad_slug', count(*) FROM {pages} WHERE NOT @rx(url, '^https?://[a-z0-9.-]+')",
    "e18_grants": ctes(PEOPLE) + f", homonyms AS (SELECT lower(given) AS g, lower(surname) AS s, count(*) AS n, min(id) AS id FROM people GROUP BY lower(given), lower(surname)), awards AS (SELECT l_suppkey AS person, l_orderkey AS award, CAST(sum(l_extendedprice * 1e2) AS BIGINT) AS cents FROM {{lineitem}} GROUP BY l_suppkey, l_orderkey) SELECT p.id, CASE WHEN h.n = 1 THEN 'accept' ELSE 'review' END AS rule, count(a.award) AS awards FROM people p JOIN homonyms h ON h.g = lower(p.given) AND h.s = lower(p.surname) LEFT JOIN awards a ON a.person = p.id GROUP BY p.id, h.n",
    "e19_roster_lines": "WITH lines AS (SELECT doc_id, i, @at(ls, CAST(i AS INTEGER)) AS line FROM (SELECT doc_id, ls, @explode(@range(1, CAST(@size(ls) AS INTEGER))) AS i FROM (SELECT doc_id, @split(text, chr(10)) AS ls FROM {documents} WHERE text IS NOT NULL) a) t), marked AS (SELECT doc_id, i, line, CASE WHEN @rx(line, '[A-Za-z0-9._]+[@][A-Za-z0-9.-]+') THEN 1 ELSE 0 END AS ends FROM lines), dealt AS (SELECT doc_id, i, line, ends, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS record FROM marked) SELECT doc_id, CAST(record AS BIGINT) AS record, count(*) AS n_lines, max(CASE WHEN ends = 1 THEN regexp_extract(line, '([A-Za-z0-9._]+[@][A-Za-z0-9.-]+)', 1) END) AS mail FROM dealt GROUP BY doc_id, record HAVING max(ends) = 1",
    "e20_scoped_rewrite": ctes(DOCS) + "SELECT id, source FROM docs WHERE source <> 'src2' UNION ALL SELECT id, source FROM docs WHERE source = 'src2' AND is_active = 1",
    "e24_presence": "SELECT item_id, max(score) AS best, CASE WHEN max(score) >= 9e-1 THEN 'present' WHEN max(score) >= 5e-1 THEN 'partial' ELSE 'absent' END AS band FROM (SELECT b.item_id, 1e0 AS score FROM {benchmark} b JOIN {documents} d ON md5(d.text) = md5(b.text) UNION ALL SELECT b.item_id, 6e-1 FROM {benchmark} b JOIN {labels} l ON l.doc_id = b.item_id AND l.quality = 1 UNION ALL SELECT b.item_id, 3e-1 FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id UNION ALL SELECT item_id, 0e0 FROM {benchmark}) t GROUP BY item_id",
    "r01_tick": ctes(POSTS) + "SELECT id, 'publish' AS action FROM post WHERE status = 'O' AND (scheduled_for IS NULL OR scheduled_for <= TIMESTAMP '1998-06-01 00:00:00') UNION ALL SELECT id, 'remind' FROM post WHERE status = 'P' AND scheduled_for - INTERVAL 60 MINUTE <= TIMESTAMP '1998-06-01 00:00:00' UNION ALL SELECT id, 'unsend' FROM post WHERE status = 'F' AND scheduled_for + INTERVAL 24 HOUR <= TIMESTAMP '1998-06-01 00:00:00'",
    "r04_emitted_once": "SELECT min(event_id) AS event_id, emit_key FROM (SELECT event_id, event_type || ':' || CAST(user_id AS STRING) || ':' || @json(props, '$.k') AS emit_key FROM {events}) t GROUP BY emit_key",
    "r09_delivery_status": ctes(POSTS) + "SELECT post_id, CASE WHEN max(CASE WHEN status = 'sent' THEN 1 ELSE 0 END) = 1 THEN 'sent' WHEN count_if(status = 'failed') >= 3 THEN 'failed' WHEN count_if(status = 'failed') > 0 THEN 'retry' ELSE 'scheduled' END AS status FROM delivery GROUP BY post_id",
    "r12_since_boundary": ctes(Q) + "SELECT id, question FROM q WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' AND confidence < 50",
    # profiles and reads
    "z02_profile": ctes(PEOPLE, AREAS) + ", areas AS (SELECT person_id, count(DISTINCT regexp_replace(lower(tag), '[^a-z0-9]', ''@g)) AS areas FROM tagged GROUP BY person_id) SELECT p.id, CASE WHEN category = 'faculty' THEN org_id END AS home, CASE WHEN category = 'joint' THEN org_id END AS joint_org, coalesce(a.areas, 0) AS areas, CASE WHEN metric >= 0 THEN CAST(floor(metric) AS BIGINT) END AS citations FROM people p LEFT JOIN areas a ON a.person_id = p.id",
    "z03_leadership": ctes(PEOPLE) + "SELECT id, CASE WHEN @rx(title, 'Associate Dean') THEN 'associate_dean' WHEN @rx(title, 'Dean') THEN 'dean' END AS office FROM people WHERE @rx(title, 'Dean')",
    "z04_org_by_slug": ctes(ORG) + "SELECT id, CAST(@json(attrs, '$.org_id') AS BIGINT) AS bridged FROM (SELECT id, lower(replace(name, ' ', '-')) AS slug, chr(123) || '\"org_id\":' || CAST(id AS STRING) || chr(125) AS attrs FROM org) t WHERE slug LIKE '%a%'",
    "z05_funding_view": "SELECT o_custkey, o_orderkey, place, active FROM (SELECT o_custkey, o_orderkey, o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AS active, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS place FROM {orders} WHERE o_totalprice > 1000) t",
    "z07_upcoming": "SELECT name, origin FROM (SELECT name, origin, row_number() OVER (PARTITION BY name ORDER BY priority, event_id) AS r FROM (SELECT event_type || ':' || CAST(user_id AS STRING) AS name, 'first' AS origin, 0 AS priority, event_id FROM {events} WHERE event_type <> 'view' AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-17 00:00:00' UNION ALL SELECT event_type || ':' || CAST(user_id AS STRING), 'second', 1, event_id FROM {events} WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-17 00:00:00') a) t WHERE r = 1",
    "z09_fixture_dates": "SELECT a.o_orderkey, least(a.o_custkey, a.o_orderkey % 50) AS low, greatest(a.o_custkey, a.o_orderkey % 50) AS high, CAST(CAST(coalesce(l.l_shipdate, a.o_orderdate) AS DATE) AS STRING) AS shown_on FROM {orders} a LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS l_shipdate FROM {lineitem} WHERE l_linenumber = 1 GROUP BY l_orderkey) l ON l.l_orderkey = a.o_orderkey",
    "z10_standings": "SELECT l_suppkey, CASE WHEN d > 0 THEN '+' || CAST(d AS STRING) ELSE CAST(d AS STRING) END AS difference FROM (SELECT l_suppkey, count_if(l_returnflag = 'A') - count_if(l_returnflag = 'R') AS d FROM {lineitem} GROUP BY l_suppkey) t",
    "z11_sections": "SELECT doc_id, i AS ordinal, @at(parts, CAST(i AS INTEGER)) AS body FROM (SELECT doc_id, parts, @explode(@range(1, CAST(@size(parts) AS INTEGER))) AS i FROM (SELECT doc_id, @split(text, chr(10)) AS parts FROM {documents} WHERE text IS NOT NULL) a) t WHERE length(@at(parts, CAST(i AS INTEGER))) > 0",
    "z13_metric_table": "SELECT page_id, i AS ordinal, @at(names, CAST(i AS INTEGER)) AS name, @at(targets, CAST(i AS INTEGER)) AS target FROM (SELECT page_id, names, targets, @explode(@range(1, CAST(@size(names) AS INTEGER))) AS i FROM (SELECT page_id, @rxall(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS names, @rxall(html, '<a href=\"([^\"]*)\">[^<]*</a>', 1) AS targets FROM {pages}) a WHERE @size(names) > 0 AND @size(names) = @size(targets)) t",
    "z14_targets": ctes(PEOPLE) + "SELECT id FROM people p ANTI JOIN (SELECT l_suppkey FROM {lineitem} WHERE l_discount = 0 AND l_quantity = 50) h ON h.l_suppkey = p.id ANTI JOIN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0) t ON t.s_suppkey = p.id WHERE category IN ('faculty', 'joint')",
    # one person of a surname is a strict match; of several, the one with the best metric stays uncertain, the others are blocked
    "z15_candidate_decision": ctes(PEOPLE)
    + "SELECT id, CASE WHEN metric < 0 THEN 'reject' WHEN n = 1 THEN 'strict' WHEN r = 1 THEN 'uncertain' ELSE 'blocked' END AS decision "
    "FROM (SELECT id, metric, count(*) OVER (PARTITION BY lower(surname)) AS n, row_number() OVER (PARTITION BY lower(surname) ORDER BY metric DESC, id) AS r FROM people) t",
    # a field of the new bag replaces the old one; a null of the new bag removes it
    "z16_profile_merge": ctes(PEOPLE)
    + ", old AS (SELECT id, slug AS site, CAST(floor(metric) AS BIGINT) AS citations FROM people), "
    "new AS (SELECT l_suppkey AS id, max(CASE WHEN l_returnflag = 'R' THEN 'https://new/' || CAST(l_orderkey AS STRING) END) AS site, count(*) AS citations FROM {lineitem} WHERE l_quantity > 45 GROUP BY l_suppkey) "
    "SELECT o.id, CASE WHEN n.id IS NULL THEN o.site ELSE n.site END AS site, CASE WHEN n.id IS NULL THEN o.citations ELSE n.citations END AS citations FROM old o LEFT JOIN new n ON n.id = o.id",
    "z17_fact_items": "SELECT substr(sha1(norm), 1, 12) AS item_key, min(doc_id) AS doc_id, count(*) AS facts FROM (SELECT doc_id, lower(trim(text)) AS norm FROM {documents} WHERE text IS NOT NULL) t GROUP BY norm",
    "z20_rank_regressions": ctes(Q) + ", before AS (SELECT question, row_number() OVER (ORDER BY count(*) DESC, question) AS r FROM q WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY question), after AS (SELECT question, row_number() OVER (ORDER BY count(*) DESC, question) AS r FROM q WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY question) SELECT b.question, a.question IS NULL AS lost FROM before b LEFT JOIN after a ON a.question = b.question WHERE a.r IS NULL OR a.r > b.r + 1",
    "z21_band_grid": ctes(Q) + "SELECT CAST(t.threshold AS BIGINT) AS threshold, count_if(q.confidence >= t.threshold AND q.mode = 'error') AS leaks, count_if(coalesce(q.confidence < t.threshold, true)) AS deflects FROM q CROSS JOIN (SELECT @explode(@range(20, 80, 15)) AS threshold) t GROUP BY t.threshold",
    # a miss belongs to the first stage that had not what the next one needs
    "z24_attribution": ctes(Q, FEEDBACK)
    + ", pool AS (SELECT DISTINCT user_id FROM fb WHERE rating = 'thumbs_up'), asked AS (SELECT question, count(*) AS n FROM q GROUP BY question) "
    "SELECT q.id, CASE WHEN topic IS NULL THEN 'CONFIG' WHEN a.n = 1 THEN 'ROUTER' WHEN p.user_id IS NULL THEN 'POOL' WHEN confidence < 50 THEN 'RANK' ELSE 'COMPOSE' END AS stage "
    "FROM q JOIN asked a ON a.question = q.question LEFT JOIN pool p ON p.user_id = q.user_id WHERE confidence < 60",
    "z25_control_gates": "SELECT lang, count(*) AS n, count_if(l.quality = 1) AS good, " + pct("count_if(l.quality = 1)", "count(*)") + " AS share, count_if(l.toxic = 1) = 0 AS gate FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY lang",
    "z26_label_merge": "SELECT d.doc_id, l.quality, l.quality IS NOT NULL AS confirmed, CASE WHEN substr(md5(CAST(d.doc_id AS STRING) || ':3'), 1, 1) = '0' THEN 1 - l.quality ELSE l.quality END AS canary FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id",
    "z27_arm_table": ctes(Q) + ", arms AS (SELECT mode, count(*) AS n, count_if(confidence >= 50) AS answered, count_if(confidence >= 50 AND topic IS NULL) AS leaks FROM q GROUP BY mode) SELECT a.mode, a.n, a.answered, a.leaks, a.leaks <= b.leaks AS gate FROM arms a CROSS JOIN (SELECT max(leaks) AS leaks FROM arms WHERE mode = 'view') b",
    "z28_ground_truth": ctes(PEOPLE)
    + ", sites AS (SELECT DISTINCT l_suppkey AS id FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity > 45) "
    "SELECT p.id, concat_ws(',', CASE WHEN title IS NOT NULL THEN 'title' END, CASE WHEN metric >= 0 THEN 'metric' END, CASE WHEN s.id IS NOT NULL THEN 'site' END) AS present, "
    "concat_ws(',', CASE WHEN title IS NULL THEN 'title' END, CASE WHEN metric IS NULL OR metric < 0 THEN 'metric' END, CASE WHEN s.id IS NULL THEN 'site' END) AS missing FROM people p LEFT JOIN sites s ON s.id = p.id",
    "z30_display_title": ctes(PEOPLE) + "SELECT DISTINCT id, CASE WHEN shown LIKE '%,%' THEN given || ' ' || surname ELSE shown END AS name, title || CASE WHEN category = 'joint' THEN ' (joint appointment)' ELSE '' END AS label FROM people",
    "z31_research_faculty": ctes(ORG, PEOPLE) + ", scopes AS (SELECT id AS org_id, id AS member_org FROM org UNION ALL SELECT parent_id, id FROM org WHERE parent_id IS NOT NULL) SELECT DISTINCT s.org_id, p.id FROM scopes s JOIN people p ON p.org_id = s.member_org ANTI JOIN (SELECT id FROM people WHERE title = 'Lecturer') l ON l.id = p.id WHERE p.category = 'faculty'",
}
