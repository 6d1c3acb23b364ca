"""App logs and change events derived from the test tables.

The tables hold no raw log text and no change envelopes, so both are written here
as the JSON text a log collector or a capture tool would send. The operators get
that text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DATABASE = "shop"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table spread over the cores, however few files it has."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


def epoch_millis(ts: str) -> str:
    """Epoch millis of a zone-less timestamp, whatever the session time zone."""
    return (
        f"(unix_date(to_date({ts})) * 86400L + hour({ts}) * 3600 + minute({ts}) * 60) * 1000"
        f" + CAST(floor(extract(SECOND FROM {ts}) * 1000) AS BIGINT)"
    )


# The JSON text of one app log. Absent members are NULL here and not written.
_LOG_TEXT = """to_json(named_struct(
  'common', named_struct(
    'mid', if(event_id % 89 <> 0, concat('mid_', user_id), NULL),
    'is_new', if(event_id % 3 = 0, '0', '1')),
  'start', if(is_page, NULL, named_struct('entry', event_type, 'loading_time', k)),
  'page', if(is_page, named_struct('page_id', event_type, 'during_time', k), NULL),
  'displays', CASE
    WHEN NOT is_page THEN NULL
    WHEN k % 4 > 0
      THEN transform(sequence(1, k % 4), i -> named_struct('item', i, 'order', i))
    WHEN event_id % 2 = 0 THEN CAST(array() AS ARRAY<STRUCT<item: INT, `order`: INT>>) END,
  'ts', millis,
  'extra', named_struct('id', event_id, 'amount', value)))"""


def log_columns(events: DataFrame) -> DataFrame:
    """One app log per event: ``event_id``, ``ts`` (millis) and the text ``value``.

    ``event_id % 97 = 0`` is cut short, ``event_id % 89 = 0`` has no ``mid``,
    sign-ups are start records, the rest are page records with ``k % 4`` displays.
    """
    typed = events.selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "event_type <> 'signup' AS is_page",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        f"{epoch_millis('ts')} AS millis",
    )
    texts = typed.selectExpr("event_id", "millis AS ts", f"{_LOG_TEXT} AS text")
    return texts.selectExpr(
        "event_id",
        "ts",
        "if(event_id % 97 = 0, left(text, length(text) - 1), text) AS value",
    )


def app_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_columns(spread(table(spark, sf_dir, "events"), "event_id"))


def odd_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page log per event with null members, a number of more than 50 digits, one with a
    zero at its end, the word null in a text, and on every third a line break."""
    events = spread(table(spark, sf_dir, "events"), "event_id")
    return events.selectExpr(
        "event_id",
        """concat('{"common":{"mid":"mid_', user_id, '","is_new":"0"},"gone":null,',
             if(event_id % 3 = 0, '\n ', ''), '"page":{"long":', repeat('1234567890', 5), event_id,
             ',"m":1.50,"note":"a null","z":null}}') AS value""",
    )


# An object whose numbers no type holds, with null members and white space to be left out.
_ODD_OBJECT = """concat('{"z" : 1e400,"long":', repeat('1234567890', 5), event_id,
  if(event_id % 3 = 0, ',\n "gone":null', ''),
  ',"m":1.50,"note":"a ]}, null","in":[{"x":-0.0, "no":null},"[",10.0]}')"""


def odd_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page log per event whose page and first display are such an object; its second
    display is a number."""
    events = spread(table(spark, sf_dir, "events"), "event_id")
    return events.selectExpr(
        "event_id",
        f"""concat('{{"page":', {_ODD_OBJECT}, ',"common":{{"mid":"mid_', user_id,
             '","is_new":"0","v":1.50}}, "displays":[', {_ODD_OBJECT}, ', 2.500],"ts":', event_id, '}}') AS value""",
    )


def odd_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update per event whose new row is such an object."""
    events = spread(table(spark, sf_dir, "events"), "event_id")
    return events.selectExpr(
        "event_id",
        f"""concat('{{"op":"u","after": ', {_ODD_OBJECT}, ',"before":{{"was" :1.50}},"source":{{"db":"{DATABASE}",',
             '"table":"odd"}},"ts_ms":', event_id, '}}') AS value""",
    )


def _envelope(name: str, op: str, before: str, after: str, ts_ms: str) -> str:
    return f"""to_json(named_struct(
      'before', {before},
      'after', {after},
      'source', named_struct('db', '{DATABASE}', 'table', '{name}'),
      'op', {op},
      'ts_ms', {ts_ms})) AS value"""


def _histories(rows: DataFrame, name: str, images: list[str], changes: list[str]) -> DataFrame:
    """Envelopes of each row's changes, given as (seq, op, before, after) or NULL.

    ``images`` are select items that define the row images ``first`` and ``second``.
    """
    steps = (
        rows.selectExpr("*", *images)
        .selectExpr("o_orderdate", f"explode(array_compact(array({', '.join(changes)}))) AS step")
        .selectExpr("step.*", f"{epoch_millis('o_orderdate')} + step.seq AS ts_ms")
    )
    return steps.selectExpr("seq", _envelope(name, "op", "before", "after", "ts_ms"))


def _change(seq: int, op: str, before: str, after: str) -> str:
    return f"named_struct('seq', {seq}, 'op', {op}, 'before', {before}, 'after', {after})"


def order_changes(orders: DataFrame) -> DataFrame:
    """Change events of the orders table: ``seq`` and the envelope text ``value``.

    Every order is inserted (a create or, in two of three cases, a snapshot read);
    even ones are then updated and every fifth one is deleted.
    """
    image = (
        "named_struct('cust', o_custkey, 'id', o_orderkey, 'price', {price},"
        " 'status', o_orderstatus)"
    )
    nothing = "if(true, NULL, first)"
    updated = "o_orderkey % 2 = 0"
    return _histories(
        orders,
        "orders",
        [
            image.format(price="o_totalprice") + " AS first",
            image.format(price="o_totalprice + 1") + " AS second",
        ],
        [
            _change(1, "if(o_orderkey % 3 = 1, 'c', 'r')", nothing, "first"),
            f"if({updated}, {_change(2, repr('u'), 'first', 'second')}, NULL)",
            "if(o_orderkey % 5 = 0, "
            + _change(3, repr("d"), f"if({updated}, second, first)", nothing)
            + ", NULL)",
        ],
    )


def customer_changes(customers: DataFrame) -> DataFrame:
    """Snapshot reads of the customer table, in the same form."""
    image = "named_struct('balance', c_acctbal, 'id', c_custkey, 'name', c_name)"
    nothing = f"if(true, NULL, {image})"
    return customers.selectExpr(
        "1 AS seq", _envelope("customer", "'r'", nothing, image, "c_custkey * 10")
    )


def attribute_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a table with three numbers and two names, one row per order.

    Rows are read as a snapshot; every third one is then renamed and every seventh
    one deleted.
    """
    image = (
        "named_struct('id', o_orderkey, 'spu_id', o_custkey,"
        " 'base_sale_attr_id', o_orderkey % 10, 'sale_attr_value_name', {name},"
        " 'sale_attr_name', o_orderpriority)"
    )
    nothing = "if(true, NULL, first)"
    renamed = "o_orderkey % 3 = 0"
    return _histories(
        spread(table(spark, sf_dir, "orders"), "o_orderkey"),
        "spu_sale_attr_value",
        [
            image.format(name="o_orderstatus") + " AS first",
            image.format(name="concat('new ', o_orderstatus)") + " AS second",
        ],
        [
            _change(1, repr("r"), nothing, "first"),
            f"if({renamed}, {_change(2, repr('u'), 'first', 'second')}, NULL)",
            "if(o_orderkey % 7 = 0, "
            + _change(3, repr("d"), f"if({renamed}, second, first)", nothing)
            + ", NULL)",
        ],
    )


# Fixed value: what is added to the key of an order that gets another one.
MOVED = 1_000_000_000


def rekeyed_changes(spark: SparkSession, sf_dir: str, old_rows: bool = True) -> DataFrame:
    """Change events of orders of which every seventh gets another key.

    As :func:`order_changes`, with the change of the key (``seq`` 3) between the update and
    the delete (4). Without ``old_rows`` the old row holds the key only, where an event needs
    it: deletes and changes of the key; every fifteenth order is then deleted twice (4, 5).
    """
    row = "named_struct('cust', o_custkey, 'id', {id}, 'price', {price}, 'status', o_orderstatus)"
    only = (
        "named_struct('cust', if(true, NULL, o_custkey), 'id', {id}, 'price',"
        " if(true, NULL, o_totalprice), 'status', if(true, NULL, o_orderstatus))"
    )
    old = row if old_rows else only
    nothing = "if(true, NULL, first)"
    updated, moved = "o_orderkey % 2 = 0", "o_orderkey % 7 = 0"
    deleted = _change(4, repr("d"), "gone", nothing)
    return _histories(
        spread(table(spark, sf_dir, "orders"), "o_orderkey"),
        "orders",
        [
            f"if({updated}, o_totalprice + 1, o_totalprice) AS now",
            f"if({moved}, o_orderkey + {MOVED}, o_orderkey) AS last_id",
            row.format(id="CAST(o_orderkey AS BIGINT)", price="o_totalprice") + " AS first",
            row.format(id="CAST(o_orderkey AS BIGINT)", price="now") + " AS second",
            old.format(id="CAST(o_orderkey AS BIGINT)", price="now") + " AS left_row",
            row.format(id="CAST(last_id AS BIGINT)", price="now") + " AS third",
            old.format(id="CAST(last_id AS BIGINT)", price="now") + " AS gone",
        ],
        [
            _change(1, "if(o_orderkey % 3 = 1, 'c', 'r')", nothing, "first"),
            f"if({updated}, {_change(2, repr('u'), 'first' if old_rows else nothing, 'second')}, NULL)",
            f"if({moved}, {_change(3, repr('u'), 'left_row', 'third')}, NULL)",
            f"if(o_orderkey % 5 = 0, {deleted}, NULL)",
            f"if({str(not old_rows).lower()} AND o_orderkey % 15 = 0,"
            f" {_change(5, repr('d'), 'gone', nothing)}, NULL)",
        ],
    )


# Fixed value: from this order date on, rows have a note and prices with cents.
CHANGED_ON = "1995-06-01"


def evolving_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One create event per order and the number of its arrival: of the first ones the row
    has a whole price, later ones have cents and a further column."""
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    early = f"o_orderdate < DATE'{CHANGED_ON}'"
    key, price = "CAST(o_orderkey AS STRING)", "CAST({} AS STRING)"
    row = (
        f"""concat('{{"id":', {key}, ',"price":', if({early}, {price.format("CAST(floor(o_totalprice) AS BIGINT)")},"""
        f""" {price.format("CAST(o_totalprice AS DECIMAL(15,2))")}), if({early}, '', concat(',"note":"n', {key}, '"')), '}}')"""
    )
    return orders.selectExpr(
        f"if({early}, 1, 2) AS arrival",
        "CAST(o_orderkey AS BIGINT) AS order_id",
        f"""concat('{{"before":null,"after":', {row}, ',"source":{{"db":"{DATABASE}","table":"orders"}},"op":"c","ts_ms":', {key}, '}}') AS value""",
    )


# What is wrong with an event, by the order's key modulo 20; all others are creates.
_FAULTS = {
    0: "left({text}, length({text}) - 1)",
    1: "replace({text}, '\"source\"', '\"origin\"')",
    2: "replace({text}, '\"op\":\"c\"', '\"op\":\"x\"')",
    3: "replace({text}, '\"op\":\"c\"', '\"op\":null')",
    4: "replace({text}, '\"id\":', '\"id\":\"x\",\"was\":')",
    5: "replace({text}, '\"price\":', '\"price\":\"none\",\"was\":')",
    6: "replace({text}, '\"id\":', '\"id\":3000000000')",
    7: "replace({text}, '\"ts_ms\":', '\"at\":')",
}


def faulty_text(cast: str) -> str:
    """SQL, for Spark and the oracle, of an order's create event with the faults above;
    ``cast`` makes text of a number."""
    key, price = (cast.format(c) for c in ("o_orderkey", "o_custkey"))
    text = (
        f"""concat('{{"before":null,"after":{{"id":', {key}, ',"price":', {price},"""
        f""" '}},"source":{{"db":"{DATABASE}","table":"orders"}},"op":"c","ts_ms":', {key}, '}}')"""
    )
    cases = " ".join(f"WHEN {k} THEN {fault.format(text=text)}" for k, fault in _FAULTS.items())
    return f"CASE o_orderkey % 20 {cases} ELSE {text} END"


def faulty_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per order, ``order_id`` and the text ``value``, among them unreadable ones,
    ones without source, operation or time, and values of another type than declared."""
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    text = faulty_text("CAST({} AS STRING)")
    return orders.selectExpr("CAST(o_orderkey AS BIGINT) AS order_id", f"{text} AS value")


def database_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed of the whole database: two tables on one stream."""
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    return order_changes(orders).unionByName(customer_changes(table(spark, sf_dir, "customer")))
