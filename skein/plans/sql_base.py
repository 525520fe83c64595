"""The domain tables of skein.sources.domain as DuckDB common table expressions."""

from __future__ import annotations

from skein.sources.domain import SEEDS

CTES = {
    "turns": """SELECT conv_id AS session_id, turn + 1 AS turn_no, printf('turn-%03d', turn + 1) AS turn_id, CASE role WHEN 'assistant' THEN 'dm' ELSE 'player' END AS speaker,
  text || CASE conv_id % 5 WHEN 0 THEN ' The red plate gleams.' WHEN 1 THEN ' A small widget, and char-customer-7 waits.' WHEN 2 THEN ' Redplate and char-customer-77.' WHEN 3 THEN ' Old rod! hot ring?' ELSE '' END AS text
  FROM conversations WHERE role IN ('user', 'assistant')""",
    "scenes": "SELECT source AS session_id, doc_id + 1 AS turn_no, printf('turn-%03d', doc_id + 1) AS turn_id, coalesce(text, '')"
    + "".join(f" || CASE WHEN doc_id % {k} = 0 THEN chr(10) || '{line}' ELSE '' END" for k, line in SEEDS)
    + " AS text FROM documents",
    "entities": """SELECT 'char-customer-' || c_custkey AS id, c_name AS name, 'character' AS type, c_mktsegment AS identity, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'trades in ' || lower(c_mktsegment) END AS current_status, 'loc-nation-' || c_nationkey AS location, CAST(1 + c_custkey % 40 AS BIGINT) AS first_seen, CAST(41 + c_custkey % 60 AS BIGINT) AS last_updated FROM customer
  UNION ALL SELECT 'faction-supplier-' || s_suppkey, s_name, 'faction', 'supplier', NULL, 'loc-nation-' || s_nationkey, 1 + s_suppkey % 50, 51 + s_suppkey % 50 FROM supplier
  UNION ALL SELECT 'item-part-' || p_partkey, p_name, 'item', p_type, NULL, NULL, 1 + p_partkey % 80, 1 + p_partkey % 80 + p_partkey % 21 FROM part
  UNION ALL SELECT 'loc-nation-' || n_nationkey, n_name, 'location', 'nation', NULL, 'loc-region-' || n_regionkey, 1, 100 FROM nation
  UNION ALL SELECT 'loc-region-' || r_regionkey, r_name, 'location', 'region', NULL, NULL, 1, 100 FROM region""",
    "interactions": """SELECT 'char-customer-' || o_custkey AS source_id, 'faction-supplier-' || l_suppkey AS target_id, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS BIGINT) AS turn, o_orderkey * 10 + l_linenumber AS ord,
  CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'active' ELSE 'dormant' END AS status, CASE WHEN o_orderpriority LIKE '1%' THEN 'alliance' WHEN o_orderpriority LIKE '2%' THEN 'rivalry' ELSE 'trade' END AS rel_type, 'order ' || o_orderpriority || ' of ' || CAST(l_quantity AS INTEGER) AS description
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "edges": """SELECT source_id, target_id, m.rel_type AS rel_type, m.status AS status, first_turn, m.turn AS last_turn FROM (SELECT source_id, target_id, min(turn) AS first_turn, max({'turn': turn, 'ord': ord, 'status': status, 'rel_type': rel_type}) AS m FROM interactions GROUP BY ALL)
  UNION ALL SELECT 'char-customer-' || c_custkey, 'loc-nation-' || c_nationkey, 'spatial', NULL, 1, 1 + c_custkey % 90 FROM customer
  UNION ALL SELECT 'loc-nation-' || n_nationkey, 'loc-region-' || n_regionkey, 'spatial', 'active', 1, 100 FROM nation""",
    "nevents": """SELECT 'evt-' || event_id AS id, event_id AS ord, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS turn_no, CASE event_type WHEN 'view' THEN 'examination' WHEN 'click' THEN 'encounter' WHEN 'purchase' THEN 'offering' WHEN 'signup' THEN 'arrival' ELSE 'other' END AS type,
  ['char-user-' || user_id, 'item-k-' || json_extract_string(props, '$.k')] AS refs, upper(event_type[1]) || event_type[2:] || ' by User' || user_id || ' near Gate' || json_extract_string(props, '$.k') AS description FROM events""",
    "run_log": """SELECT run, turn_no, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, run[1] AS arm FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' WHEN 2 THEN 'B1' ELSE 'B2' END AS run, hour(ts) + 24 * date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS turn_no, event_id % 500 + 100 AS tokens FROM events) GROUP BY run, turn_no""",
}
NEEDS = {"edges": ["interactions"]}


def over(tables: str, body: str) -> str:
    """A query over domain tables: ``body`` behind their common table expressions; body may add its own with a leading comma."""
    names: list[str] = []
    for t in tables.split():
        names += [x for x in (*NEEDS.get(t, []), t) if x not in names]
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + body if names else body
