"""Relational operators: scans, predicates, joins, aggregations, ranks, top-k, sets and hierarchies."""

from korvane.operators.bindings import AREAS, CLOSURE, DOCS, FEEDBACK, ORG, PEOPLE, POSTS, Q, SCORES, SERIES, VERSIONS

R6 = "floor(({}) * 1e6 + 0.5) / 1e6"


def r6(x: str) -> str:
    return R6.format(x)


def ctes(*parts: str) -> str:
    return ("WITH RECURSIVE " if CLOSURE in parts else "WITH ") + ",\n".join(parts) + "\n"


SQL: dict[str, str] = {
    # scans and predicates
    "p01_active_items": ctes(DOCS) + "SELECT id, type, org_id FROM docs WHERE is_active = 1",
    "p02_allowed_set": ctes(ORG, CLOSURE, DOCS) + "SELECT d.id, d.type FROM docs d WHERE is_active = 1 AND type IN ('en', 'de') AND source NOT IN ('src1', 'src2') AND EXISTS (SELECT 1 FROM closure c WHERE c.id = d.org_id AND c.ancestor = 2)",
    "p04_json_projection": "SELECT event_id, CAST(@json(props, '$.k') AS BIGINT) AS k FROM {events} WHERE CAST(@json(props, '$.k') AS BIGINT) < 10",
    "p05_search_page": ctes(PEOPLE) + "SELECT id, shown, title FROM people WHERE lower(shown) LIKE '%a%' OR lower(title) LIKE '%dean%' ORDER BY lower(shown), id LIMIT 20 OFFSET 10",
    "p07_enum_guard": ctes(ORG) + "SELECT id, name FROM org WHERE type = 'college' AND 'college' IN ('root', 'college', 'department') ORDER BY name, id",
    "p08_last_days": ctes(Q) + "SELECT id, mode FROM q WHERE @day(ts) >= DATE '2024-01-31' - INTERVAL 7 DAY",
    "p09_junk_pii": "SELECT doc_id FROM {documents} WHERE @size(@split(text, ' ')) >= 5 AND NOT @rx(text, '[A-Za-z0-9._]+[@][A-Za-z0-9.-]+')",
    "p10_keyword_event": "SELECT doc_id FROM {documents} WHERE @rx(lower(text), 'free|lunch|table|the') AND NOT @rx(lower(text), 'license|policy')",
    "p11_stakes": "SELECT page_id, CASE WHEN @rx(lower(url), 'admission|tuition|financial') THEN 'high' WHEN @rx(lower(html), 'deadline|fee|price') THEN 'medium' ELSE 'low' END AS stakes FROM {pages}",
    "p13_title_category": ctes(PEOPLE) + "SELECT id, CASE WHEN @rx(title, 'Dean') THEN 'leadership' WHEN @rx(title, 'Professor') THEN 'faculty' WHEN @rx(title, 'Lecturer') THEN 'teaching' ELSE 'staff' END AS role FROM people",
    "p14_seniority": ctes(PEOPLE) + "SELECT id, CASE WHEN contains(lower(title), 'distinguished professor') THEN 0 WHEN contains(lower(title), 'associate professor') THEN 2 WHEN contains(lower(title), 'assistant professor') THEN 3 WHEN contains(lower(title), 'professor') THEN 1 ELSE 9 END AS seniority FROM people",
    "p15_stratum": ctes(Q) + "SELECT id, CASE WHEN confidence IS NULL OR confidence <= 0 THEN 'deflected' WHEN confidence >= 60 THEN 'high' ELSE 'low' END AS stratum FROM q",
    "p16_null_rule": ctes(Q) + "SELECT count(*) AS low, CAST((SELECT count(*) FROM q WHERE confidence IS NULL) AS BIGINT) AS unknown FROM q WHERE confidence < 50",
    # joins
    "j01_people_in_org": ctes(ORG, PEOPLE) + "SELECT o.id AS org_id, p.id, coalesce(p.title, p.category) AS title FROM people p JOIN org o ON o.id = p.org_id WHERE p.category IN ('faculty', 'joint')",
    "j02_roster_union": ctes(PEOPLE, DOCS) + "SELECT p.org_id, p.shown FROM people p WHERE p.id IN (SELECT id FROM docs WHERE is_active = 1) UNION SELECT org_id, shown FROM people WHERE category = 'faculty'",
    "j04_left_zero_rows": ctes(SCORES) + "SELECT p.number, count(s.number) AS votes FROM presenter p LEFT JOIN score s ON s.number = p.number GROUP BY p.number",
    "j05_preaggregated": ctes(Q, FEEDBACK) + f"SELECT q.topic, count(*) AS asked, CAST(sum(coalesce(f.down, 0)) AS BIGINT) AS down, {r6('avg(coalesce(q.confidence, 0.0))')} AS avg_conf FROM q LEFT JOIN (SELECT user_id, k, count(*) AS down FROM fb WHERE rating = 'thumbs_down' GROUP BY user_id, k) f ON f.user_id = q.user_id AND f.k = q.k GROUP BY q.topic",
    "j06_orphans": "SELECT d.doc_id FROM {documents} d ANTI JOIN {embeddings} e ON e.vec_id = d.doc_id",
    "j07_preaggregated_scalars": ctes(PEOPLE) + "SELECT p.id, count(l.l_orderkey) AS n_lines, min(l.l_orderkey) AS first_order FROM people p LEFT JOIN {lineitem} l ON l.l_suppkey = p.id GROUP BY p.id",
    # documents without a natural key (here: of no known language) meet by their id
    "j08_key_expression": "WITH a AS (SELECT doc_id, coalesce(CASE WHEN lang <> 'fr' THEN lang || ':' || md5(text) END, 'id:' || CAST(doc_id AS STRING)) AS key FROM {documents} WHERE source <> 'src3'), "
    "b AS (SELECT doc_id, coalesce(CASE WHEN lang <> 'fr' THEN lang || ':' || md5(text) END, 'id:' || CAST(doc_id AS STRING)) AS key FROM {documents} WHERE source <> 'src5') "
    "SELECT a.doc_id, min(b.doc_id) AS first_id, count(*) AS n FROM a JOIN b ON b.key = a.key GROUP BY a.doc_id",
    "j13_others_present": "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) - 1 AS others FROM {conversations}",
    "j14_left_latest": ctes(Q, FEEDBACK) + "SELECT q.id, f.rating FROM q LEFT JOIN (SELECT user_id, k, rating, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, id DESC) AS n FROM fb) f ON f.user_id = q.user_id AND f.k = q.k AND f.n = 1",
    "j15_reminders": ctes(POSTS) + "SELECT id, scheduled_for - INTERVAL 60 MINUTE AS fire FROM post WHERE scheduled_for IS NOT NULL AND scheduled_for - INTERVAL 60 MINUTE <= TIMESTAMP '1998-01-01 00:00:00'",
    # aggregations
    "a01_stats": ctes(Q) + "SELECT count(*) AS questions, count(DISTINCT user_id) AS users, count_if(confidence >= 50) AS answered, count_if(topic IS NULL) AS untopical FROM q",
    "a02_by_mode": ctes(Q) + "SELECT mode, count(*) AS n, count(DISTINCT user_id) AS users FROM q GROUP BY mode",
    "a03_gaps": ctes(Q, FEEDBACK) + f"SELECT q.question, count(*) AS asked, CAST(sum(coalesce(f.down, 0)) AS BIGINT) AS down, {r6('2e0 * count(*) + 3e0 * sum(coalesce(f.down, 0)) + 5e0 * (1e0 - avg(coalesce(q.confidence, 0.0)) / 100.0)')} AS priority FROM q LEFT JOIN (SELECT user_id, k, count(*) AS down FROM fb WHERE rating = 'thumbs_down' GROUP BY user_id, k) f ON f.user_id = q.user_id AND f.k = q.k GROUP BY q.question ORDER BY priority DESC, q.question LIMIT 20",
    "a04_satisfaction": ctes(FEEDBACK) + f"SELECT user_id, CASE WHEN count_if(rating IN ('thumbs_up', 'thumbs_down')) > 0 THEN {r6('1e0 * count_if(rating = ' + chr(39) + 'thumbs_up' + chr(39) + ') / count_if(rating IN (' + chr(39) + 'thumbs_up' + chr(39) + ', ' + chr(39) + 'thumbs_down' + chr(39) + '))')} END AS rate FROM fb GROUP BY user_id",
    "a05_window_analytics": ctes(Q) + "SELECT CAST(@day(ts) AS STRING) AS day, count(*) AS n, count_if(confidence >= 50) AS answered, count(DISTINCT user_id) AS users FROM q WHERE @day(ts) >= DATE '2024-01-31' - INTERVAL 30 DAY GROUP BY @day(ts)",
    "a06_failure_digest": ctes(Q) + "SELECT question, count(*) AS n, max(id) AS latest FROM q WHERE confidence < 50 GROUP BY question ORDER BY n DESC, question LIMIT 10",
    "a07_daily": ctes(FEEDBACK) + "SELECT CAST(@day(ts) AS STRING) AS day, count_if(rating = 'thumbs_up') AS up, count_if(rating = 'thumbs_down') AS down FROM fb GROUP BY @day(ts)",
    "a08_items_by_org": ctes(ORG, DOCS) + "SELECT o.name, d.type, count(*) AS n FROM docs d JOIN org o ON o.id = d.org_id WHERE is_active = 1 GROUP BY o.name, d.type",
    "a09_delivery_success": ctes(POSTS) + "SELECT p.kind, count(d.post_id) AS deliveries, count_if(d.status = 'sent') AS sent, count_if(d.status = 'failed') AS failed FROM post p LEFT JOIN delivery d ON d.post_id = p.id GROUP BY p.kind",
    "a10_overview": ctes(POSTS) + "SELECT min(scheduled_for) AS first_due, max(scheduled_for) AS last_due, count_if(scheduled_for IS NULL) AS undated, count_if(status = 'O') AS open_posts FROM post",
    "a11_having_duplicates": ctes(PEOPLE) + "SELECT given, surname, count(*) AS n FROM people GROUP BY given, surname HAVING count(*) > 1",
    "a12_census": ctes(ORG, PEOPLE) + "SELECT type, count(*) AS n FROM org GROUP BY type UNION ALL SELECT 'person' AS type, count(*) AS n FROM people",
    "a13_area_counts": ctes(AREAS) + "SELECT folded, tag AS shown, people FROM (SELECT a.folded, a.tag, b.people, row_number() OVER (PARTITION BY a.folded ORDER BY a.n DESC, a.tag) AS r FROM (SELECT lower(tag) AS folded, tag, count(*) AS n FROM tagged GROUP BY lower(tag), tag) a JOIN (SELECT lower(tag) AS folded, count(DISTINCT person_id) AS people FROM tagged GROUP BY lower(tag)) b ON b.folded = a.folded) t WHERE r = 1",
    "a15_person_areas": ctes(AREAS) + "SELECT person_id, @join(@sort(@distinct(@list(lower(tag)))), '|') AS areas FROM tagged GROUP BY person_id",
    "a16_metric_ranking": ctes(ORG, CLOSURE, PEOPLE) + f"SELECT c.ancestor, p.id, {r6('p.metric')} AS metric, rank() OVER (PARTITION BY c.ancestor ORDER BY p.metric DESC) AS place FROM people p JOIN closure c ON c.id = p.org_id",
    "a17_scopes": ctes(ORG, CLOSURE, PEOPLE) + "SELECT c.ancestor AS org_id, count(DISTINCT p.id) AS people FROM people p JOIN closure c ON c.id = p.org_id GROUP BY c.ancestor",
    "a18_progress": ctes(SCORES) + f"SELECT p.event_id, count(DISTINCT p.number) AS presenters, count(s.number) AS scores, count(DISTINCT s.number) AS scored, {r6('1e2 * count(DISTINCT s.number) / count(DISTINCT p.number)')} AS coverage FROM presenter p LEFT JOIN score s ON s.number = p.number GROUP BY p.event_id",
    "a21_votes": ctes(SCORES) + "SELECT event_id, number, votes, CASE WHEN votes > 0 THEN rank() OVER (PARTITION BY event_id ORDER BY votes DESC) END AS place FROM (SELECT p.event_id, p.number, count(s.number) AS votes FROM presenter p LEFT JOIN score s ON s.number = p.number GROUP BY p.event_id, p.number) t",
    "a22_coverage": ctes(PEOPLE) + "SELECT org_id, count(DISTINCT id) AS people, count_if(metric >= 0) AS with_metric FROM people GROUP BY org_id",
    "a23_ladder": ctes(PEOPLE) + "SELECT title, count(*) AS n, count(DISTINCT slug) AS slugs FROM people GROUP BY title",
    "a24_funding": "SELECT c_nationkey AS org_id, count(DISTINCT c_custkey) AS people, count(o_orderkey) AS awards, count_if(o_orderdate >= TIMESTAMP '1998-01-01 00:00:00') AS active, max(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END) AS last_fiscal FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_nationkey",
    "a29_kappa": f"SELECT count(*) AS n, {r6('(avg(CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END) - (avg(1e0 * quality) * avg(1e0 * toxic) + (1 - avg(1e0 * quality)) * (1 - avg(1e0 * toxic)))) / (1 - (avg(1e0 * quality) * avg(1e0 * toxic) + (1 - avg(1e0 * quality)) * (1 - avg(1e0 * toxic))))')} AS kappa FROM {{labels}}",
    "a34_vocabulary_signature": "SELECT sha1(CAST(count(*) AS STRING) || ':' || CAST(CAST(sum(length(text)) AS BIGINT) AS STRING) || ':' || CAST(max(doc_id) AS STRING)) AS signature FROM {documents}",
    "a35_preserved_counts": ctes(VERSIONS) + "SELECT (SELECT count(*) FROM prev) AS before, (SELECT count(*) FROM fresh) AS after, (SELECT count(*) FROM prev JOIN fresh ON fresh.natural_key = prev.natural_key AND fresh.h = prev.h) AS kept",
    # ranks
    "w01_leaderboard": ctes(SCORES) + f"SELECT event_id, number, {r6('score')} AS score, n, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY event_id ORDER BY score DESC NULLS LAST) END AS place, n < 2 AS low_coverage FROM (SELECT p.event_id, p.number, avg(s.final_score) AS score, count(s.number) AS n FROM presenter p LEFT JOIN score s ON s.number = p.number GROUP BY p.event_id, p.number) t",
    "w02_dense_sequence": ctes(PEOPLE) + "SELECT id, CASE WHEN metric >= 0 THEN row_number() OVER (ORDER BY CASE WHEN metric >= 0 THEN metric END DESC NULLS LAST, lower(shown), slug) END AS place FROM people",
    "w04_top_with_ties": ctes(PEOPLE) + "SELECT id, title, place FROM (SELECT id, title, rank() OVER (ORDER BY title) AS place FROM people) t WHERE place <= 5",
    "w11_first_seen": "SELECT doc_id, text_key FROM (SELECT doc_id, md5(text) AS text_key, row_number() OVER (PARTITION BY md5(text) ORDER BY CASE lang WHEN 'en' THEN 0 ELSE 1 END, doc_id) AS r FROM {documents}) t WHERE r = 1",
    "w12_neighbours": "SELECT conv_id, turn, text || coalesce(' | ' || lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || coalesce(' | ' || lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS passage FROM {conversations}",
    "w13_pairwise_slopes": ctes(SERIES) + f"SELECT a.id, {r6('median((ln(b.n) - ln(a.n)) / (b.y - a.y))')} AS slope FROM yearly a JOIN yearly b ON b.id = a.id AND b.y > a.y WHERE a.y BETWEEN 1996 AND 2000 AND b.y BETWEEN 1996 AND 2000 GROUP BY a.id",
    "w14_dense_window": ctes(SERIES) + "SELECT id, CAST(sum(n) AS BIGINT) AS total FROM yearly WHERE y BETWEEN 1996 AND 2000 GROUP BY id HAVING count(*) = 5",
    "w16_peak": ctes(SERIES) + "SELECT id, y, n FROM (SELECT id, y, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, y) AS r FROM yearly) t WHERE r = 1",
    "w17_highlights": "SELECT l_suppkey, l_orderkey, l_linenumber, place FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM {lineitem}) t WHERE place <= 5",
    "w18_latest_per_key": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, @day(ts) ORDER BY ts DESC, event_id DESC) AS r FROM {events}) t WHERE r = 1",
    "w21_last_turns": "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM {conversations}) t WHERE r <= 4",
    "w22_adjacent_turn": "SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM {conversations}",
    "w23_running_score": f"SELECT event_id, {r6('sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)')} AS running FROM {{events}}",
    # top-k and sets
    "t05_multi_key_sort": ctes(PEOPLE) + "SELECT id, row_number() OVER (ORDER BY lower(surname), lower(given), slug) AS place FROM people",
    "t06_due_queue": ctes(POSTS) + "SELECT id, scheduled_for FROM post WHERE status = 'O' ORDER BY scheduled_for NULLS FIRST, id LIMIT 50",
    "t08_top_topics": ctes(Q) + "SELECT topic, count(*) AS n FROM q WHERE topic IS NOT NULL GROUP BY topic ORDER BY n DESC, topic LIMIT 5",
    "t09_exemplar_cap": "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM {embeddings}) t WHERE r <= 8",
    "u04_survival_guard": ctes(VERSIONS) + "SELECT p.natural_key FROM prev p ANTI JOIN fresh f ON f.natural_key = p.natural_key ANTI JOIN fresh g ON g.h = p.h",
    "u05_keyed_union": ctes(VERSIONS) + "SELECT natural_key, h FROM prev UNION ALL SELECT f.natural_key, f.h FROM fresh f ANTI JOIN prev p ON p.natural_key = f.natural_key",
    "u06_content_dedup": "SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY sha1(html) ORDER BY length(url), url, page_id) AS r FROM {pages}) t WHERE r = 1",
    "u08_stale_duplicates": ctes(DOCS) + ", titled AS (SELECT id, source, md5(text) AS h, @at(@split(text, chr(10)), 1) AS title FROM docs WHERE text IS NOT NULL), g AS (SELECT title, source, h, count(*) AS n FROM titled GROUP BY title, source, h), t AS (SELECT title, sum(n) AS n FROM g GROUP BY title HAVING count(*) > 1), s AS (SELECT title, source, sum(n) AS n FROM g GROUP BY title, source), k AS (SELECT title, h, sum(n) AS n FROM g GROUP BY title, h) SELECT x.id FROM titled x JOIN t ON t.title = x.title JOIN s ON s.title = x.title AND s.source = x.source JOIN k ON k.title = x.title AND k.h = x.h JOIN g ON g.title = x.title AND g.source = x.source AND g.h = x.h WHERE t.n - s.n - k.n + g.n > 0",
    "u09_coverage_diff": ctes(VERSIONS) + "SELECT coalesce(p.natural_key, f.natural_key) AS natural_key, CASE WHEN f.natural_key IS NULL THEN 'missing' WHEN p.natural_key IS NULL THEN 'new' WHEN p.h <> f.h THEN 'changed' ELSE 'same' END AS verdict FROM prev p FULL OUTER JOIN fresh f ON f.natural_key = p.natural_key",
    "u11_idempotent": ctes(POSTS) + "SELECT min(post_id) AS post_id, dedup_key FROM (SELECT post_id, 'source:auto:' || sha1(status || '|' || CAST(l_linenumber AS STRING)) AS dedup_key FROM delivery) t GROUP BY dedup_key",
    # hierarchy
    "h01_descendants": ctes(ORG, CLOSURE) + "SELECT ancestor, id FROM closure",
    "h02_ancestors": ctes(ORG, CLOSURE) + "SELECT id, ancestor, depth FROM closure WHERE depth > 0",
    "h03_path": "WITH RECURSIVE " + ORG + ", paths(id, path) AS (SELECT id, name AS path FROM org WHERE parent_id IS NULL UNION ALL SELECT o.id, p.path || ' > ' || o.name FROM paths p JOIN org o ON o.parent_id = p.id) SELECT id, path FROM paths",
    "h04_inherited_setting": ctes(ORG, CLOSURE) + ", settings AS (SELECT CAST(0 AS BIGINT) AS org_id, 'tone' AS k, 'plain' AS v UNION ALL SELECT CAST(2 AS BIGINT), 'tone', 'warm' UNION ALL SELECT CAST(103 AS BIGINT), 'tone', 'brief') SELECT id, v FROM (SELECT c.id, s.v, row_number() OVER (PARTITION BY c.id ORDER BY c.depth) AS r FROM closure c JOIN settings s ON s.org_id = c.ancestor) t WHERE r = 1",
    "h05_climb": ctes(ORG, CLOSURE) + "SELECT c.id, c.ancestor AS college FROM closure c JOIN org o ON o.id = c.ancestor WHERE o.type = 'college' AND c.depth < 6",
    "h07_leaves": ctes(ORG) + "SELECT o.id, o.name FROM org o ANTI JOIN org c ON c.parent_id = o.id",
    "h08_departments_with_faculty": ctes(ORG, PEOPLE) + "SELECT o.id, count(*) AS faculty FROM org o JOIN people p ON p.org_id = o.id WHERE p.category = 'faculty' GROUP BY o.id HAVING count(*) > 0",
    # organisations whose parent is not among the active ones
    "h11_tree_orphans": ctes(ORG) + ", live AS (SELECT id FROM org WHERE name <> 'ASIA') SELECT o.id FROM org o ANTI JOIN live p ON p.id = o.parent_id WHERE o.parent_id IS NOT NULL",
    "h13_primary_role": ctes(PEOPLE) + "SELECT given, surname, id, title FROM (SELECT given, surname, id, title, row_number() OVER (PARTITION BY given, surname ORDER BY CASE category WHEN 'faculty' THEN 0 WHEN 'officer' THEN 1 ELSE 2 END, id) AS r FROM people) t WHERE r = 1",
}
