"""The inputs of newsloom.sources.views as DuckDB CTEs, for the queries' SQL."""

MENTION = """mention AS (SELECT event_id AS seq, event_type || '|' || strftime(ts, '%Y-%m-%d') AS abstract, 'user_' || user_id AS entity,
  ts AS reported_at, 'k' || json_extract_string(props, '$.k') AS source, event_type, value FROM events)"""
ENT = """ent AS (SELECT sha1('ent:' || entity) AS entity_id, entity AS name, min(reported_at) AS first_seen, max(reported_at) AS last_seen FROM mention GROUP BY entity)"""
EV = """ev AS (SELECT sha1('evt:' || abstract) AS event_id, abstract, event_type, min(reported_at) AS first_seen, max(reported_at) AS last_seen FROM mention GROUP BY ALL)"""
PART = """part_ AS (SELECT sha1('evt:' || abstract) AS event_id, sha1('ent:' || entity) AS entity_id, min(reported_at) AS time FROM mention GROUP BY abstract, entity)"""
KG = ", ".join((MENTION, ENT, EV, PART))
REL = """rel AS (SELECT l_orderkey AS event, l_linenumber AS line, s_name AS subject, l_returnflag AS predicate, n_name AS object, l_shipdate AS time,
  CASE WHEN l_linestatus = 'O' THEN 'state' ELSE 'event' END AS kind, 'line ' || l_linenumber AS evidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey)"""
EDGE = """edge AS (SELECT * FROM (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_id, o_orderkey AS to_id,
  CASE o_orderpriority[1] WHEN '1' THEN 'causes' WHEN '2' THEN 'escalates' WHEN '3' THEN 'responds_to' WHEN '4' THEN 'related' ELSE 'follows' END AS edge_type,
  o_orderdate AS time, round(o_totalprice % 1, 2) AS confidence FROM orders) WHERE from_id IS NOT NULL)"""
REDIRECT = "redirect AS (SELECT p_partkey AS from_id, p_partkey // 2 AS to_id FROM part WHERE p_partkey > 0)"
NEWS = """news AS (SELECT doc_id AS id, source, 'http://' || source || '/' || (doc_id % 300) AS url, split_part(text, chr(10), 1) AS title, text AS content, lang AS language,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT) AS published_at FROM documents)"""
TASK = """task AS (SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'entity_merge' ELSE 'event_merge' END AS type,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'failed' END AS status, o_orderpriority[1]::INT AS priority,
  sha1('payload:' || (o_orderkey % 5000)) AS input_hash, o_orderdate AS created_at, o_totalprice AS score FROM orders)"""


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """body after the views' WITH clause; a body that begins with a comma goes on with more views."""
    if not views:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(views)}{'' if body.startswith(',') else ' '}{body}"
