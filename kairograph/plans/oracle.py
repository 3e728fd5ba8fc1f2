"""The graph tables as common table expressions for DuckDB, each computed once; a query's oracle SQL starts from them."""

NOW = "1998-06-15 12:00:00"
ZONE = "America/New_York"

GRAPH = f"""
WITH k AS MATERIALIZED (SELECT TIMESTAMP '{NOW}' AS now),
plan_rows AS MATERIALIZED (SELECT *, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS raw, o_orderkey % 11 = 0 AS ad FROM orders),
plan_at AS MATERIALIZED (SELECT *, CASE WHEN ad THEN timezone('UTC', timezone('{ZONE}', date_trunc('day', timezone('{ZONE}', timezone('UTC', raw))))) ELSE raw END AS st FROM plan_rows),
task_rows AS MATERIALIZED (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS ship, min(l_linestatus) AS status, min(l_partkey) AS partkey, min(o_orderdate) AS od,
              (l_orderkey * 7 + l_linenumber) % 17 = 0 AS floating, l_orderkey * 10 + l_linenumber AS key, 't' || l_orderkey || '-' || l_linenumber AS tid
              FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_linenumber),
nodes AS MATERIALIZED (
  SELECT 'p' || c_custkey AS id, 'person' AS kind, c_mktsegment || ' ' || c_name AS title, NULL::VARCHAR AS body, NULL::DOUBLE[] AS embedding, NULL::TIMESTAMP AS occurred_at, NULL::TIMESTAMP AS expires_at,
         CAST(c_custkey % 50 AS INTEGER) AS access_count, 'agent-' || (c_custkey % 7) AS agent_id, TIMESTAMP '1992-01-01' + to_minutes(c_custkey) AS created_at FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'place', s_name, NULL, NULL, NULL, NULL, CAST(s_suppkey % 50 AS INTEGER), 'agent-' || (s_suppkey % 7), TIMESTAMP '1992-01-01' + to_minutes(s_suppkey) FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'place', n_name, NULL, NULL, NULL, NULL, CAST(n_nationkey % 50 AS INTEGER), 'agent-' || (n_nationkey % 7), TIMESTAMP '1992-01-01' + to_minutes(n_nationkey) FROM nation
  UNION ALL SELECT 'h' || p_partkey, 'memory', p_brand || ' ' || p_name, NULL, NULL, NULL, NULL, CAST(p_partkey % 50 AS INTEGER), 'agent-' || (p_partkey % 7), TIMESTAMP '1992-01-01' + to_minutes(p_partkey) FROM part
  UNION ALL SELECT 'd' || doc_id, 'memory', substr(text, 1, 80), text, CAST(embedding AS DOUBLE[]), TIMESTAMP '1998-01-01' + to_hours(doc_id),
         CASE WHEN doc_id % 20 = 0 THEN now - INTERVAL 1 DAY WHEN doc_id % 10 = 0 THEN now + INTERVAL 30 DAY END, CAST(doc_id % 50 AS INTEGER), 'agent-' || (doc_id % 7), TIMESTAMP '1992-01-01' + to_minutes(doc_id)
         FROM documents LEFT JOIN embeddings ON vec_id = doc_id, k
  UNION ALL SELECT 'o' || o_orderkey, 'plan', CASE WHEN o_orderkey % 97 = 0 THEN 'Fall 2098 review' ELSE o_orderpriority || ' review ' || (o_orderkey % 50) END, NULL, NULL, st, NULL, CAST(o_orderkey % 50 AS INTEGER),
         'agent-' || (o_orderkey % 7), TIMESTAMP '1992-01-01' + to_minutes(o_orderkey) FROM plan_at
  UNION ALL SELECT tid, 'task', 'HW ' || l_linenumber || ' part ' || (partkey % 20), NULL, NULL, NULL, NULL, CAST(key % 50 AS INTEGER), 'agent-' || (key % 7), TIMESTAMP '1992-01-01' + to_minutes(key) FROM task_rows),
live AS MATERIALIZED (SELECT nodes.* FROM nodes, k WHERE expires_at IS NULL OR expires_at > now),
plans AS MATERIALIZED (SELECT 'o' || o_orderkey AS node_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN st + INTERVAL 10 DAY ELSE st + INTERVAL 2 HOUR END AS end_at, ad AS all_day,
          CASE WHEN o_orderkey % 6 = 0 THEN 'Europe/Paris' END AS time_zone, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'P' THEN 'no' END AS rsvp FROM plan_at),
tasks AS MATERIALIZED (SELECT tid AS node_id, CASE WHEN NOT floating THEN CAST(least(od, ship) AS DATE) END AS opens_on, CASE WHEN NOT floating THEN ship + INTERVAL 299 MINUTE END AS closes_at, status = 'F' AND NOT floating AS done FROM task_rows),
persons AS MATERIALIZED (SELECT 'p' || c_custkey AS node_id, CASE WHEN c_custkey % 3 = 0 THEN [lower(c_mktsegment)] ELSE []::VARCHAR[] END AS aliases FROM customer),
places AS MATERIALIZED (SELECT 's' || s_suppkey AS node_id, CASE s_suppkey % 3 WHEN 1 THEN s_suppkey || ' Market St' WHEN 2 THEN 'Market Street' END AS address FROM supplier UNION ALL SELECT 'n' || n_nationkey, NULL FROM nation),
venues AS MATERIALIZED (SELECT l_orderkey, min(l_suppkey) AS suppkey, min(l_partkey) AS partkey FROM lineitem GROUP BY l_orderkey),
raw_edges AS MATERIALIZED (
  SELECT 'PARTICIPANT' AS type, o_orderkey AS key, 'p' || o_custkey AS src_id, 'o' || o_orderkey AS dst_id, NULL::VARCHAR AS room FROM orders
  UNION ALL SELECT 'HAS_ITEM', key, 'h' || partkey, tid, NULL FROM task_rows
  UNION ALL SELECT 'AT_LOCATION', l_orderkey, 'o' || l_orderkey, 's' || suppkey, CAST(l_orderkey % 400 AS VARCHAR) FROM venues
  UNION ALL SELECT 'HAS_PLAN', l_orderkey, 'h' || partkey, 'o' || l_orderkey, NULL FROM venues WHERE l_orderkey % 4 = 0
  UNION ALL SELECT 'HAS_NOTE', o_orderkey, 'o' || o_orderkey, 'd' || doc_id, NULL FROM orders JOIN documents ON o_orderkey = doc_id * 3
  UNION ALL SELECT 'LIVES_AT', c_custkey, 'p' || c_custkey, 'n' || c_nationkey, NULL FROM customer
  UNION ALL SELECT 'LEARNED_FROM', doc_id, 'd' || doc_id, 'p' || doc_id, NULL FROM documents WHERE doc_id % 50 = 7),
edges AS MATERIALIZED (SELECT type || '-' || src_id || '-' || dst_id AS id, src_id, dst_id, type, room, CASE key % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence,
          TIMESTAMP '1992-01-01' + to_minutes(key) AS created_at, CASE WHEN key % 13 = 0 THEN TIMESTAMP '1992-01-02' + to_minutes(key) END AS valid_to FROM raw_edges),
cur AS MATERIALIZED (SELECT * FROM edges WHERE valid_to IS NULL),
history AS MATERIALIZED (
  SELECT 'e' || event_id AS id, 'p' || user_id AS node_id, CASE event_type WHEN 'click' THEN 'title' WHEN 'view' THEN 'body' WHEN 'purchase' THEN 'occurred_at' WHEN 'signup' THEN 'agent_id' WHEN 'error' THEN 'deleted' END AS field,
         NULL AS new_value, CAST(embedding AS DOUBLE[]) AS embedding, ts AS changed_at FROM events LEFT JOIN embeddings ON vec_id = event_id
  UNION ALL SELECT 'done-' || tid, tid, 'done', 'true', NULL, ship + INTERVAL 239 MINUTE FROM task_rows WHERE status = 'F' AND NOT floating AND l_orderkey % 5 = 0),
hub_of AS MATERIALIZED (SELECT dst_id AS item_id, arg_min(src_id, (e.created_at, e.id)) AS hub_id, arg_min(title, (e.created_at, e.id)) AS hub_title, arg_min(agent_id, (e.created_at, e.id)) AS hub_agent
           FROM cur e JOIN live ON live.id = src_id WHERE type IN ('HAS_ITEM', 'HAS_PLAN') GROUP BY dst_id),
hubs AS MATERIALIZED (SELECT id, title, agent_id FROM live WHERE id IN (SELECT src_id FROM cur WHERE type IN ('HAS_ITEM', 'HAS_PLAN'))),
live_tasks AS MATERIALIZED (SELECT live.*, opens_on, closes_at, done, CAST(timezone('{ZONE}', timezone('UTC', closes_at)) AS DATE) AS close_day FROM live JOIN tasks ON node_id = id WHERE kind = 'task'),
hidden AS MATERIALIZED (SELECT DISTINCT dst_id AS id FROM cur WHERE type = 'HAS_PLAN'),
q AS MATERIALIZED (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 3),
steps AS MATERIALIZED (SELECT src_id AS a, dst_id AS b, confidence AS c FROM cur WHERE type <> 'HAS_PLAN' UNION ALL SELECT dst_id, src_id, confidence FROM cur WHERE type <> 'HAS_PLAN'),
"""


def oracle(text: str) -> str:
    """The graph's tables and then the query; text may begin with further tables, each `name AS (...)`, before SELECT."""
    text = text.strip()
    if text.upper().startswith("SELECT"):
        return GRAPH.rstrip().rstrip(",") + "\n" + text
    return GRAPH + text


def local(column: str, zone: str = ZONE) -> str:
    return f"timezone('{zone}', timezone('UTC', {column}))"
