"""Scalar, text and date functions, and the ETL actions made from them."""

from korvane.operators.bindings import DOCS, PEOPLE, POSTS, Q, VERSIONS
from korvane.operators.relational import ctes, r6

SQL: dict[str, str] = {
    "x01_person_name": ctes(PEOPLE) + "SELECT id, CASE WHEN contains(shown, ', ') THEN @at(@split(shown, ', '), 2) || ' ' || @at(@split(shown, ', '), 1) ELSE shown END AS name FROM people",
    "x03_initials": ctes(PEOPLE) + "SELECT id, upper(substr(given, 1, 1)) || upper(substr(surname, 1, 1)) AS initials FROM people",
    "x12_decay": ctes(Q) + f"SELECT id, {r6('CASE WHEN mode = ' + chr(39) + 'view' + chr(39) + ' THEN greatest(5e-1, 85e-2 * pow(5e-1, (CAST(@epoch(TIMESTAMP ' + chr(39) + '2024-01-31 00:00:00' + chr(39) + ') AS BIGINT) - CAST(floor(@epoch(ts)) AS BIGINT)) / 864e2 / 18e1)) WHEN mode = ' + chr(39) + 'signup' + chr(39) + ' THEN 12e-1 ELSE 1e0 END')} AS prior FROM q",
    "x16_keys": "SELECT doc_id, substr(sha1(text), 1, 12) AS short_key, md5(text) AS h FROM {documents}",
    "x25_volatile": "SELECT doc_id FROM {documents} WHERE @rx(text, '[$][0-9]|[0-9]%')",
    "d04_reminder_fire": ctes(POSTS) + "SELECT id, scheduled_for - INTERVAL 2 DAY AS fire FROM post WHERE scheduled_for IS NOT NULL",
    "d06_fiscal_year": "SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS BIGINT) AS fiscal FROM {orders}",
    "d07_staleness": "SELECT c_custkey FROM {customer} LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_seen FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey WHERE last_seen IS NULL OR last_seen <= TIMESTAMP '2001-12-31 00:00:00' - INTERVAL 365 DAY",
    "d09_watch_window": "SELECT event_id FROM {events} WHERE ts - INTERVAL 5 MINUTE <= TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-10 12:00:00' < ts + INTERVAL 4 HOUR",
    "e02_reconcile": ctes(VERSIONS) + "SELECT coalesce(p.natural_key, f.natural_key) AS natural_key, CASE WHEN p.natural_key IS NULL THEN 'insert' WHEN f.natural_key IS NULL THEN 'retire' WHEN p.h <> f.h THEN 'bump' ELSE 'unchanged' END AS action FROM prev p FULL OUTER JOIN fresh f ON f.natural_key = p.natural_key",
    "e10_chunks": "SELECT doc_id, i AS ordinal, substr(text, CAST(1 + 160 * i AS INTEGER), 200) AS chunk FROM (SELECT doc_id, text, @explode(@range(0, CAST(floor((length(text) - 1) / 160) AS INTEGER))) AS i FROM {documents} WHERE length(text) > 0) t",
    "e16_scores_valid": "SELECT o_orderkey, o_totalprice >= 0 AND o_totalprice <= 300000 AS valid FROM {orders}",
    "e17_last_vote": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) t WHERE r = 1",
    "e21_stratified": ctes(Q) + "SELECT mode, id FROM (SELECT mode, id, row_number() OVER (PARTITION BY mode ORDER BY md5(CAST(id AS STRING) || ':7'), id) AS r FROM q) t WHERE r <= 10",
    "e23_calibration": ctes(Q) + f", cuts AS (SELECT confidence, count(*) AS n, count_if(topic IS NOT NULL) AS good FROM q WHERE confidence IS NOT NULL GROUP BY confidence) SELECT confidence, CAST(sum(n) OVER w AS BIGINT) AS covered, {r6('1e0 * sum(good) OVER w / sum(n) OVER w')} AS precision_so_far FROM cuts WINDOW w AS (ORDER BY confidence DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "r07_sessions": "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS turns, min(event_id) AS first_event FROM (SELECT user_id, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, event_id, CASE WHEN CAST(floor(@epoch(ts)) AS BIGINT) - CAST(floor(@epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id))) AS BIGINT) <= 3600 THEN 0 ELSE 1 END AS fresh FROM {events}) a) b GROUP BY user_id, session",
    "z01_own_scores": "SELECT o_custkey, o_orderkey, o_totalprice FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'",
    "z06_home_faculty": ctes(PEOPLE) + "SELECT org_id, id, title FROM people WHERE category = 'faculty' AND title <> 'Lecturer'",
    "z08_previews": "SELECT conv_id, turn, substr(replace(text, chr(10), ' '), 1, 120) AS preview FROM {conversations}",
    "z18_recent_queries": "SELECT norm, conv_id, turn FROM (SELECT lower(trim(text)) AS norm, conv_id, turn, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY conv_id DESC, turn DESC) AS r FROM {conversations} WHERE role = 'user') t WHERE r = 1",
    "z22_variance": ctes(Q) + f"SELECT mode, {r6('avg(confidence)')} AS mean, {r6('stddev_samp(confidence)')} AS spread, {r6('min(confidence)')} AS low, {r6('max(confidence)')} AS high FROM q GROUP BY mode",
    "z23_abstain": ctes(Q) + "SELECT mode, count_if(confidence IS NULL) AS abstained, count_if(coalesce(confidence < 20, false)) AS leaks FROM q GROUP BY mode",
    "z29_scoped_wipe": ctes(DOCS) + "SELECT id FROM docs WHERE NOT (source = 'src3' AND type = 'en')",
    "n03_gate": ctes(Q) + "SELECT id, CASE WHEN confidence IS NULL THEN 'deflect' WHEN confidence >= 60 THEN 'answer' WHEN confidence >= 30 AND topic IS NOT NULL THEN 'hedge' ELSE 'abstain' END AS decision FROM q",
    "n01_intents": "SELECT conv_id, turn, CASE WHEN @rx(lower(text), '^(hi|hello|hey)') AND length(text) < 30 THEN 'greeting' WHEN @rx(lower(text), 'thank') AND length(text) < 40 THEN 'thanks' WHEN contains(text, '?') THEN 'question' ELSE 'statement' END AS intent FROM {conversations}",
}
