"""Common table expressions that give the tables of the data model their rows."""

ORG = """org AS (SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'world' AS name, 'root' AS type
  UNION ALL SELECT CAST(1 + r_regionkey AS BIGINT), CAST(0 AS BIGINT), r_name, 'college' FROM {region}
  UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), n_name, 'department' FROM {nation})"""
CLOSURE = """closure(id, ancestor, depth) AS (SELECT id, id AS ancestor, 0 AS depth FROM org
  UNION ALL SELECT c.id, o.parent_id, c.depth + 1 FROM closure c JOIN org o ON o.id = c.ancestor WHERE o.parent_id IS NOT NULL)"""
PEOPLE = """people AS (SELECT s_suppkey AS id, 's/' || CAST(s_suppkey AS STRING) AS slug, @at(@split(p_name, ' '), 1) AS given, @at(@split(p_name, ' '), 2) AS surname,
  CASE WHEN s_suppkey % 2 = 0 THEN @at(@split(p_name, ' '), 2) || ', ' || @at(@split(p_name, ' '), 1) ELSE p_name END AS shown,
  CAST(100 + s_nationkey AS BIGINT) AS org_id, s_acctbal AS metric,
  CASE WHEN s_acctbal < 0 THEN 'Lecturer' WHEN s_acctbal < 3000 THEN 'Assistant Professor' WHEN s_acctbal < 6000 THEN 'Associate Professor' ELSE 'Distinguished Professor and Dean' END AS title,
  CASE s_suppkey % 4 WHEN 0 THEN 'faculty' WHEN 1 THEN 'staff' WHEN 2 THEN 'officer' ELSE 'joint' END AS category FROM {supplier} JOIN {part} ON p_partkey = s_suppkey)"""
AREAS = """tagged AS (SELECT l_suppkey AS person_id, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN lower(p_type || ' ' || @at(@split(p_name, ' '), 2)) ELSE p_type || ' ' || @at(@split(p_name, ' '), 2) END AS tag
  FROM {lineitem} JOIN {part} ON p_partkey = l_partkey)"""
Q = """q AS (SELECT event_id AS id, user_id, ts, event_type AS mode, CASE WHEN event_type <> 'error' THEN least(value, 100.0) END AS confidence,
  CASE WHEN event_type <> 'view' THEN event_type END AS topic, CAST(@json(props, '$.k') AS BIGINT) AS k, 'q' || @json(props, '$.k') AS question FROM {events})"""
FEEDBACK = """fb AS (SELECT event_id AS id, user_id, ts, CAST(@json(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'purchase' THEN 'thumbs_up' WHEN 'error' THEN 'thumbs_down' ELSE 'regenerate' END AS rating
  FROM {events} WHERE event_type IN ('purchase', 'error', 'click'))"""
SCORES = """presenter AS (SELECT c_custkey AS number, c_nationkey AS event_id, c_name AS name FROM {customer}),
score AS (SELECT o_custkey AS number, o_orderkey AS judge_id, o_totalprice AS final_score FROM {orders} WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')"""
DOCS = """docs AS (SELECT d.doc_id AS id, lang AS type, 100 + d.doc_id % 25 AS org_id, source, text, n_chars, CASE WHEN b.doc_id IS NULL THEN 1 ELSE 0 END AS is_active
  FROM {documents} d LEFT JOIN (SELECT doc_id FROM {labels} WHERE quality = 0 GROUP BY doc_id) b ON b.doc_id = d.doc_id)"""
POSTS = """post AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS kind, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS scheduled_for FROM {orders}),
delivery AS (SELECT l_orderkey AS post_id, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'sent' ELSE 'pending' END AS status, l_shipdate AS sent_at FROM {lineitem})"""
VERSIONS = """prev AS (SELECT doc_id AS natural_key, md5(text) AS h FROM {documents} WHERE source <> 'src3'),
fresh AS (SELECT doc_id AS natural_key, md5(CASE WHEN n_chars > 3000 THEN reverse(text) ELSE text END) AS h FROM {documents} WHERE lang <> 'fr')"""
SERIES = """yearly AS (SELECT l_suppkey AS id, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY l_suppkey, CAST(year(l_shipdate) AS INTEGER))"""
ASK = """ask AS (SELECT q.id, CASE q.id % 3 WHEN 0 THEN 'who is ' || lower(given) || ' ' || lower(surname) WHEN 1 THEN 'papers by ' || lower(surname) ELSE 'what about ' || lower(given) END AS text,
  lower(given) || ' ' || lower(surname) AS person_name FROM q JOIN people p ON p.id = q.k)"""
