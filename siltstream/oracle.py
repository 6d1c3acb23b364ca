"""What the queries of :mod:`siltstream.catalog` must return, as SQL for DuckDB.

The SQL works on the typed columns of the tables; only output texts are put
together as JSON.
"""

from __future__ import annotations

from siltstream.catalog import CHUNK_EVERY_MS, CHUNK_READ_MS, CHUNK_TAKES_MS, CHUNKS, SNAPSHOT_MS
from siltstream.fixtures import CHANGED_ON, MOVED, faulty_text

# One row per event: what the log text says, without the text.
_LOGS = """
typed AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts, 'mid_' || user_id AS mid,
         CASE WHEN event_id % 3 = 0 THEN '0' ELSE '1' END AS is_new,
         event_type, value AS amount,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         event_id % 97 = 0 AS is_cut,
         event_id % 89 = 0 AS no_mid,
         event_type = 'signup' AS is_start
  FROM events
), clean AS (
  SELECT *, row_number() OVER (PARTITION BY mid ORDER BY ts, event_id) > 1 AS seen
  FROM typed WHERE NOT is_cut AND NOT no_mid
), fixed AS (
  SELECT *, is_new = '1' AND seen AS corrected,
         CASE WHEN seen THEN '0' ELSE is_new END AS new_flag
  FROM clean
)"""

_START = """'{"entry":"' || event_type || '","loading_time":' || k || '}'"""
_PAGE = """'{"page_id":"' || event_type || '","during_time":' || k || '}'"""
_ITEMS = """CASE k % 4
  WHEN 1 THEN '[{"item":1,"order":1}]'
  WHEN 2 THEN '[{"item":1,"order":1},{"item":2,"order":2}]'
  WHEN 3 THEN '[{"item":1,"order":1},{"item":2,"order":2},{"item":3,"order":3}]'
  ELSE CASE WHEN event_id % 2 = 0 THEN '[]' END END"""


def _record(mid: str, flag: str) -> str:
    """The text of a log record."""
    return f"""'{{"common":{{' || {mid} || '"is_new":"' || {flag} || '"}}'
      || CASE WHEN is_start THEN ',"start":' || {_START}
              ELSE ',"page":' || {_PAGE} || coalesce(',"displays":' || {_ITEMS}, '') END
      || ',"ts":' || ts || ',"extra":{{"id":' || event_id || ',"amount":' || amount || '}}}}'"""


_SENT = _record("""CASE WHEN no_mid THEN '' ELSE '"mid":"' || mid || '",' END""", "is_new")
_STORED = _record("""'"mid":"' || mid || '",'""", "new_flag")

_ROUTES = f"""
{_LOGS}, dirty AS (
  SELECT event_id, CASE WHEN is_cut THEN left(text, length(text) - 1) ELSE text END AS value
  FROM (SELECT *, {_SENT} AS text FROM typed WHERE is_cut OR no_mid)
), started AS (
  SELECT event_id, {_START} AS value FROM fixed WHERE is_start
), paged AS (
  SELECT event_id, {_STORED} AS value FROM fixed WHERE NOT is_start
), shown AS (
  SELECT event_id, CAST(i AS INTEGER) AS position,
         '{{"common":{{"mid":"' || mid || '","is_new":"' || new_flag || '"}},"page":'
         || '{{"page_id":"' || event_type || '","during_time":' || k || '}},"ts":' || ts
         || ',"display":{{"item":' || (i + 1) || ',"order":' || (i + 1) || '}}}}' AS value
  FROM fixed, range(0, 3) AS r(i) WHERE NOT is_start AND i < k % 4
)"""

_IS_NEW = f"""
WITH {_LOGS}
SELECT event_id, mid, new_flag AS is_new, new_flag AS text_is_new, corrected FROM fixed"""

# An object whose numbers no type holds: 50 digits and more, a zero at the end, out of range.
_ODD_OBJECT = """('{"z":1e400,"long":' || repeat('1234567890', 5) || event_id
       || ',"m":1.50,"note":"a ]}, null","in":[{"x":-0.0},"[",10.0]}')"""

_FANOUT = f"""
WITH {_ROUTES}, routed AS (
  SELECT 'dwd_dirty_log' AS topic, value FROM dirty
  UNION ALL SELECT 'dwd_start_log', value FROM started
  UNION ALL SELECT 'dwd_page_log', value FROM paged
  UNION ALL SELECT 'dwd_display_log', value FROM shown
)
SELECT topic, count(*) AS records, CAST(sum(length(value)) AS BIGINT) AS chars
FROM routed GROUP BY topic"""

# One row per change of an order.
_CHANGES = """
base AS (
  SELECT o_custkey AS cust, o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status,
         epoch_us(o_orderdate) // 1000 AS at_ms
  FROM orders
), changes AS (
  SELECT 1 AS seq, CASE WHEN id % 3 = 1 THEN 'c' ELSE 'r' END AS op, cust, id, status,
         at_ms + 1 AS ts_ms, CAST(NULL AS DOUBLE) AS old_price, price AS new_price
  FROM base
  UNION ALL
  SELECT 2, 'u', cust, id, status, at_ms + 2, price, price + 1 FROM base WHERE id % 2 = 0
  UNION ALL
  SELECT 3, 'd', cust, id, status, at_ms + 3,
         CASE WHEN id % 2 = 0 THEN price + 1 ELSE price END, NULL
  FROM base WHERE id % 5 = 0
)"""


def _image(price: str, number: str) -> str:
    """Text of an order's row, NULL without a price."""
    shown = number.format(price)
    return (
        f"""'{{"cust":' || cust || ',"id":' || id || ',"price":' || {shown}"""
        """ || ',"status":"' || status || '"}'"""
    )


_DOUBLE = "CAST({} AS VARCHAR)"

_FORMATTED = f"""
{_CHANGES}, formatted AS (
  SELECT seq, op, ts_ms AS ts, 'orders' AS "tableName",
         coalesce({_image("new_price", _DOUBLE)}, '{{}}') AS data,
         coalesce({_image("old_price", _DOUBLE)}, '{{}}') AS "beforeDate"
  FROM changes
  UNION ALL
  SELECT 1, 'r', c_custkey * 10, 'customer',
         '{{"balance":' || {_DOUBLE.format("c_acctbal")} || ',"id":' || c_custkey
         || ',"name":"' || c_name || '"}}', '{{}}'
  FROM customer
), full_form AS (
  SELECT seq, data, "beforeDate", 'shop' AS db, "tableName",
         CASE op WHEN 'u' THEN 'update' WHEN 'd' THEN 'delete' ELSE 'insert' END AS type, ts
  FROM formatted
)"""

_RETRACT = f"""
WITH {_CHANGES}
SELECT seq, false AS added, cust, id, old_price AS price, status
FROM changes WHERE old_price IS NOT NULL
UNION ALL
SELECT seq, true, cust, id, new_price, status FROM changes WHERE new_price IS NOT NULL"""

_CURRENT = """
SELECT o_custkey AS cust, o_orderkey AS id,
       CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price,
       o_orderstatus AS status
FROM orders WHERE o_orderkey % 5 <> 0"""

_SNAPSHOT = f"""
WITH {_CHANGES}, at_start AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS back
  FROM changes WHERE ts_ms <= {SNAPSHOT_MS}
)
SELECT id, 'r' AS op, CAST({SNAPSHOT_MS} AS BIGINT) AS ts_ms,
       CAST(NULL AS DOUBLE) AS old_price, new_price, status
FROM at_start WHERE back = 1 AND op <> 'd'
UNION ALL
SELECT id, op, ts_ms, old_price, new_price, CASE WHEN op <> 'd' THEN status END
FROM changes WHERE ts_ms > {SNAPSHOT_MS}"""


def _json_text(text: str) -> str:
    """JSON string literal of a text that is JSON itself."""
    return f"""'"' || replace({text}, '"', chr(92) || '"') || '"'"""


def _record_text(data: str, before: str, name: str, kind: str, ts: str) -> str:
    """Text of a fully formatted change record."""
    return f"""'{{"data":' || {_json_text(data)} || ',"beforeDate":' || {_json_text(before)}
       || ',"db":"shop","tableName":"' || {name} || '","type":"' || {kind}
       || '","ts":' || {ts} || '}}'"""


_CUSTOMER_ROW = """'{"balance":' || c_acctbal || ',"id":' || c_custkey || ',"name":"' || c_name || '"}'"""

_INITIAL = f"""
WITH {_FORMATTED}, at_start AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS back
  FROM changes WHERE ts_ms <= {SNAPSHOT_MS}
), records AS (
  SELECT {_image("new_price", _DOUBLE)} AS data, '{{}}' AS before, 'orders' AS name,
         'insert' AS kind, {SNAPSHOT_MS} AS ts
  FROM at_start WHERE back = 1 AND op <> 'd'
  UNION ALL
  SELECT {_CUSTOMER_ROW}, '{{}}', 'customer', 'insert', {SNAPSHOT_MS} FROM customer
  UNION ALL
  SELECT data, "beforeDate", "tableName", type, ts FROM full_form WHERE ts > {SNAPSHOT_MS}
)
SELECT 'ods_base_db' AS topic, {_record_text("data", "before", "name", "kind", "ts")} AS value
FROM records"""

# One row per order whose key may change: its rows before and after.
_MOVES = f"""
base AS (
  SELECT o_custkey AS cust, o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status,
         CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS now,
         CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + {MOVED} ELSE o_orderkey END AS last_id
  FROM orders
)"""

_REKEYED = f"""
WITH {_MOVES}
SELECT cust, last_id AS id, now AS price, status FROM base WHERE id % 5 <> 0"""

_RETRACT_NEW = f"""
WITH {_MOVES}
SELECT 1 AS seq, 0 AS step, true AS added, cust, id, price, status FROM base
UNION ALL SELECT 2, 0, false, cust, id, price, status FROM base WHERE id % 2 = 0
UNION ALL SELECT 2, 0, true, cust, id, now, status FROM base WHERE id % 2 = 0
UNION ALL SELECT 3, 0, false, cust, id, now, status FROM base WHERE id % 7 = 0
UNION ALL SELECT 3, 1, true, cust, last_id, now, status FROM base WHERE id % 7 = 0
UNION ALL SELECT 4, 0, false, cust, last_id, now, status FROM base WHERE id % 5 = 0"""

_CHUNKED = f"""
WITH {_CHANGES}, ends AS (
  SELECT max(o_orderkey) AS last FROM orders
), placed AS (
  SELECT *, {CHUNK_READ_MS + CHUNK_TAKES_MS} + {CHUNK_EVERY_MS} * CAST(
         len(list_filter(range(1, {CHUNKS}), lambda k: last * k // {CHUNKS} <= id)) AS BIGINT) AS high
  FROM changes, ends
), at_mark AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS back
  FROM placed WHERE ts_ms <= high
)
SELECT id, 'r' AS op, high AS ts_ms, CAST(NULL AS DOUBLE) AS old_price, new_price, status
FROM at_mark WHERE back = 1 AND op <> 'd'
UNION ALL
SELECT id, op, ts_ms, old_price, new_price, CASE WHEN op <> 'd' THEN status END
FROM placed WHERE ts_ms > high"""

_FAULTY = f"""
faulty AS (
  SELECT CAST(o_orderkey AS BIGINT) AS order_id, o_orderkey % 20 AS fault, o_custkey,
         {faulty_text("CAST({} AS VARCHAR)")} AS value
  FROM orders
)"""

ORACLE_SQL: dict[str, str] = {
    "log_json_validity": """
SELECT 'log' AS kind, event_id AS id, CAST(0 AS BIGINT) AS part, event_id % 97 <> 0 AS valid
FROM events
UNION ALL
SELECT 'props', event_id, 0,
       CASE WHEN json_valid(props) THEN json_type(props) = 'OBJECT' ELSE false END FROM events
UNION ALL
SELECT 'chat', conv_id, turn,
       CASE WHEN json_valid("text") THEN json_type("text") = 'OBJECT' ELSE false END
FROM conversations""",
    "log_dirty_route": f"WITH {_ROUTES} SELECT event_id, value FROM dirty",
    "log_is_new_corrected": _IS_NEW,
    "log_is_new_stream": _IS_NEW,
    "log_start_route": f"WITH {_ROUTES} SELECT event_id, value FROM started",
    "log_page_route": f"WITH {_ROUTES} SELECT event_id, value FROM paged",
    "log_page_odd": """
SELECT event_id, '{"common":{"mid":"mid_' || user_id || '","is_new":"0"},"page":{"long":'
       || repeat('1234567890', 5) || event_id || ',"m":1.50,"note":"a null"}}' AS value
FROM events""",
    "log_display_route": f"WITH {_ROUTES} SELECT event_id, position, value FROM shown",
    "log_display_exact": f"""
SELECT event_id, CAST(0 AS INTEGER) AS position,
       '{{"common":{{"mid":"mid_' || user_id || '","is_new":"0","v":1.50}},"page":' || {_ODD_OBJECT}
       || ',"ts":' || event_id || ',"display":' || {_ODD_OBJECT} || '}}' AS value
FROM events
UNION ALL
SELECT event_id, 1, '{{"common":{{"mid":"mid_' || user_id || '","is_new":"0","v":1.50}},"page":'
       || {_ODD_OBJECT} || ',"ts":' || event_id || ',"display":2.500}}'
FROM events""",
    "log_topic_fanout": _FANOUT,
    "log_topic_fanout_stream": _FANOUT,
    "cdc_raw_events": f"""
WITH {_CHANGES}
SELECT seq, '{{'
       || coalesce('"before":' || {_image("old_price", _DOUBLE)} || ',', '')
       || coalesce('"after":' || {_image("new_price", _DOUBLE)} || ',', '')
       || '"source":{{"db":"shop","table":"orders"}},"op":"' || op || '","ts_ms":' || ts_ms
       || '}}' AS value
FROM changes""",
    "cdc_format_after": f"""
WITH {_FORMATTED}
SELECT seq, data, 'shop' AS db, "tableName", op, ts FROM formatted WHERE "tableName" = 'orders'""",
    "cdc_format_full": f"WITH {_FORMATTED} SELECT * FROM full_form",
    "cdc_format_exact": f"""
SELECT CAST(event_id AS BIGINT) AS event_id, {_ODD_OBJECT} AS data, '{{"was":1.50}}' AS "beforeDate",
       'shop' AS db, 'odd' AS "tableName", 'update' AS type, CAST(event_id AS BIGINT) AS ts
FROM events""",
    "cdc_capture_stream": f"""
WITH {_FORMATTED}
SELECT 'ods_base_db' AS topic, seq,
       '{{"data":' || {_json_text("data")} || ',"beforeDate":' || {_json_text('"beforeDate"')}
       || ',"db":"' || db || '","tableName":"' || "tableName" || '","type":"' || type
       || '","ts":' || ts || '}}' AS value
FROM full_form""",
    "cdc_snapshot_union": _SNAPSHOT,
    "cdc_snapshot_overlap": _SNAPSHOT,
    "cdc_select_star": """
SELECT CAST(o_orderkey AS INTEGER) AS id, CAST(o_custkey AS INTEGER) AS spu_id,
       CAST(o_orderkey % 10 AS INTEGER) AS base_sale_attr_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'new ' ELSE '' END || o_orderstatus
         AS sale_attr_value_name,
       o_orderpriority AS sale_attr_name
FROM orders WHERE o_orderkey % 7 <> 0""",
    "cdc_retract": _RETRACT,
    "cdc_retract_stream": _RETRACT,
    "cdc_current_state": _CURRENT,
    "cdc_current_state_stream": _CURRENT,
    "cdc_rejected_events": f"""
WITH {_FAULTY} SELECT order_id, value FROM faulty WHERE fault IN (0, 1, 2, 4, 5, 6)""",
    "cdc_current_state_faulty": f"""
WITH {_FAULTY}
SELECT CAST(order_id AS INTEGER) AS id, CAST(o_custkey AS DOUBLE) AS price
FROM faulty WHERE fault NOT IN (0, 1, 2, 4, 5, 6)""",
    "cdc_unplaced_events": f"""
WITH {_FAULTY}
SELECT CASE WHEN fault IN (0, 1, 2, 7) THEN 'ods_dirty_db' ELSE 'ods_base_db' END AS topic,
       count(*) AS records
FROM faulty WHERE fault IN (0, 1, 7) OR order_id > 100 GROUP BY 1""",
    "cdc_initial_capture_stream": _INITIAL,
    "cdc_current_rekeyed": _REKEYED,
    "cdc_current_rekeyed_stream": _REKEYED,
    "cdc_net_rekeyed": f"SELECT *, CAST(1 AS BIGINT) AS net FROM ({_REKEYED})",
    "cdc_retract_new_rows": _RETRACT_NEW,
    "cdc_retract_new_rows_stream": _RETRACT_NEW,
    "cdc_net_new_rows": f"SELECT *, CAST(1 AS BIGINT) AS net FROM ({_REKEYED})",
    "cdc_evolving_stream": f"""
SELECT CAST(o_orderkey AS BIGINT) AS id,
       CAST(CAST(CASE WHEN o_orderdate < DATE '{CHANGED_ON}' THEN floor(o_totalprice) ELSE o_totalprice END
            AS DECIMAL(17,2)) AS VARCHAR) AS price,
       CASE WHEN o_orderdate < DATE '{CHANGED_ON}' THEN NULL ELSE 'n' || o_orderkey END AS note,
       CASE WHEN o_orderdate < DATE '{CHANGED_ON}' THEN 1 ELSE 2 END AS version
FROM orders""",
    "cdc_chunked_union": _CHUNKED,
    "cdc_chunked_capture_stream": _CHUNKED,
    "sink_repeats_dropped": _FANOUT,
    "sink_repeats_dropped_stream": _FANOUT,
    "sink_default_topic": """
SELECT CASE WHEN event_type = 'signup' THEN 'dwd_default_topic' ELSE event_type END AS topic,
       count(*) AS records, count(*) AS ids
FROM events GROUP BY 1""",
    "cdc_net_rows": f"SELECT *, CAST(1 AS BIGINT) AS net FROM ({_CURRENT})",
}
