import json
import random

import pytest
from pyspark.sql import functions as F

from siltstream.functions import change_images as I
from siltstream.operators import changelog as C
from siltstream.plans import change_capture as P

ROW = "id bigint, name string, price double"
OLD = {"id": 1, "name": "old", "price": 1.5}
NEW = {"id": 1, "name": "new", "price": 2.5}


def _event(op="u", before=OLD, after=NEW, ts_ms=7, db="shop", table="t", **members):
    event = {"before": before, "after": after, "source": {"db": db, "table": table}}
    return json.dumps(event | {"op": op, "ts_ms": ts_ms} | members)


def _feed(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq int, value string")


def _parse(spark, texts, row=None):
    return C.parse_changes(_feed(spark, texts), row)


def _by_seq(frame):
    return {r.seq: r for r in frame.collect()}


FULL_CASES = {
    "snapshot": (_event("r", before=None), "insert", {}, NEW),
    "create": (_event("c", before=None), "insert", {}, NEW),
    "update": (_event("u"), "update", OLD, NEW),
    "delete": (_event("d", after=None), "delete", OLD, {}),
    "no op": (_event(None), "", OLD, NEW),
    "before of a create": (_event("c"), "insert", {}, NEW),
    "after of a delete": (_event("d"), "delete", OLD, {}),
    "update without images": (_event("u", before=None, after=None), "update", {}, {}),
    "image is no object": (_event("u", before=5, after="x"), "update", {}, {}),
}


@pytest.mark.parametrize("typed", [False, True])
def test_full_form_per_operation(spark, typed):
    changes = _parse(spark, [case[0] for case in FULL_CASES.values()], ROW if typed else None)
    rows = _by_seq(C.format_full(changes))
    for seq, (name, (_, kind, before, after)) in enumerate(FULL_CASES.items()):
        row = rows[seq]
        assert (row.type, json.loads(row.beforeDate), json.loads(row.data)) == (
            kind, before, after,
        ), name
        assert (row.db, row.tableName, row.ts) == ("shop", "t", 7)


@pytest.mark.parametrize("typed", [False, True])
def test_after_form_per_operation(spark, typed):
    texts = [
        _event("r", before=None), _event("c", before=None), _event("u"),
        _event("d", after=None), _event(None), _event("x"),
    ]
    rows = _by_seq(C.format_after(_parse(spark, texts, ROW if typed else None)))
    assert [rows[i].op for i in range(6)] == ["r", "c", "u", "d", None, "x"]
    assert [json.loads(rows[i].data) for i in range(6)] == [NEW, NEW, NEW, {}, NEW, NEW]


REJECTED = ["", "null", "5", "[]", "{", '{"op":"c"}', _event() + "x", '{"source":null}', None]


def test_unreadable_envelopes_are_rejected_by_both_forms(spark):
    changes = _parse(spark, REJECTED)
    assert C.format_after(changes).count() == C.format_full(changes).count() == 0
    rejected = _by_seq(C.rejected_changes(changes, unknown_ops=False))
    assert [rejected[i].value for i in range(len(REJECTED))] == REJECTED


def test_unknown_operation_is_rejected_by_the_full_form_only(spark):
    changes = _parse(spark, [_event("x"), _event("u")])
    assert [r.seq for r in C.format_full(changes).collect()] == [1]
    assert [r.seq for r in C.rejected_changes(changes).collect()] == [0]
    assert C.rejected_changes(changes, unknown_ops=False).count() == 0


def test_null_columns_are_left_out(spark):
    image = {"id": 1, "name": None, "price": 2.0}
    for row in (None, ROW):
        (formatted,) = C.format_full(_parse(spark, [_event("c", after=image)], row)).collect()
        assert json.loads(formatted.data) == {"id": 1, "price": 2.0}


def test_schema_free_images_keep_long_numbers(spark):
    text = _event("c", after=None).replace('"after": null', '"after": {"d":12345678901234567.12345}')
    (formatted,) = C.format_after(_parse(spark, [text])).collect()
    assert formatted.data == '{"d":12345678901234567.12345}'


def test_records_are_json_with_images_as_strings(spark):
    changes = _parse(spark, [_event("u"), _event(None, ts_ms=None)])
    full = _by_seq(C.to_records(C.format_full(changes), C.FULL_FIELDS))
    record = json.loads(full[0].value)
    assert list(record) == list(C.FULL_FIELDS)
    assert json.loads(record["data"]) == NEW and json.loads(record["beforeDate"]) == OLD
    after = _by_seq(C.to_records(C.format_after(changes), C.AFTER_FIELDS))
    assert list(json.loads(after[0].value)) == list(C.AFTER_FIELDS)
    assert list(json.loads(after[1].value)) == ["data", "db", "tableName"]


def test_capture_routes_every_event_once(spark):
    texts = [_event("r", before=None), "junk", _event("x"), _event("d", after=None, table="u")]
    rows = _by_seq(P.database_records(_feed(spark, texts)))
    assert [rows[i].topic for i in range(4)] == [
        C.CHANGE_TOPIC, C.DIRTY_CHANGE_TOPIC, C.DIRTY_CHANGE_TOPIC, C.CHANGE_TOPIC,
    ]
    assert [rows[i].value for i in (1, 2)] == texts[1:3]
    assert json.loads(rows[3].value)["tableName"] == "u"


def test_capture_equals_the_full_form(spark, sf_dir):
    from siltstream import fixtures as X

    feed = X.database_changes(spark, sf_dir)
    one_pass = P.database_records(feed).select("seq", "value")
    formatted = C.to_records(C.format_full(C.parse_changes(feed)), C.FULL_FIELDS)
    assert one_pass.exceptAll(formatted).isEmpty() and formatted.exceptAll(one_pass).isEmpty()


def test_one_table_is_selected(spark):
    texts = [_event(), _event(table="u"), _event(db="other"), "junk"]
    assert [r.value for r in P.table_events(_feed(spark, texts), "shop", "t").collect()] == texts[:1]
    (record,) = P.table_records(_feed(spark, texts), "shop", "u").collect()
    assert json.loads(record.value)["tableName"] == "u"


def test_quoted_time_is_read(spark):
    (row,) = _parse(spark, [_event(ts_ms="8")]).collect()
    assert row.ts_ms == 8


def test_op_names(spark):
    codes = spark.createDataFrame([(c,) for c in ("r", "c", "u", "d", None, "x")], "op string")
    names = [r[0] for r in codes.select(I.op_name(F.col("op"))).collect()]
    assert names == ["insert", "insert", "update", "delete", "", None]


def test_retract_per_operation(spark):
    texts = [
        _event("r", before=None), _event("c", before=None), _event("u"),
        _event("d", after=None), _event(None), _event("x"), "junk",
    ]
    rows = C.retract(_parse(spark, texts, ROW)).collect()
    steps = {}
    for r in rows:
        steps.setdefault(r.seq, []).append((r.added, r.name))
    assert steps == {
        0: [(True, "new")],
        1: [(True, "new")],
        2: [(False, "old"), (True, "new")],
        3: [(False, "old")],
        4: [(False, "old"), (True, "new")],
    }


def _random_history(n_keys, n_events, seed):
    """Events of keys of which one holds a third, and the table they lead to."""
    random.seed(seed)
    table, events = {}, []
    for seq in range(n_events):
        key = 0 if random.random() < 0.34 else random.randrange(1, n_keys)
        old = table.get(key)
        row = {"id": key, "name": random.choice("ab"), "price": float(seq % 3)}
        if old is None:
            events.append(_event(random.choice("rc"), before=None, after=row, ts_ms=seq // 5))
            table[key] = row
        elif random.random() < 0.3:
            events.append(_event("d", before=old, after=None, ts_ms=seq // 5))
            del table[key]
        else:
            events.append(_event("u", before=old, after=row, ts_ms=seq // 5))
            table[key] = row
    return events, table


def _rows(frame):
    return sorted((r.id, r.name, r.price) for r in frame.collect())


def _expected(table):
    return sorted((r["id"], r["name"], r["price"]) for r in table.values())


def test_current_state_and_net_rows_agree_with_brute_force(spark):
    events, table = _random_history(40, 1500, seed=5)
    feed = _feed(spark, events).repartition(5)
    changes = C.parse_changes(feed, ROW)
    assert _rows(C.current_state(changes, ["id"], ["ts_ms", "seq"])) == _expected(table)
    net = C.net_rows(C.retract(changes), ["id", "name", "price"])
    assert {r.net for r in net.collect()} == {1}
    assert _rows(net) == _expected(table)


def test_current_state_is_combined_before_the_shuffle(spark):
    frame = C.current_state(_parse(spark, [_event()], ROW), ["id"], ["ts_ms", "seq"])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan
    assert plan.count("from_json") == 1


def test_key_of_several_columns(spark):
    texts = [
        _event("c", before=None, after={"id": 1, "name": "a", "price": 1}),
        _event("c", before=None, after={"id": 1, "name": "b", "price": 1}),
        _event("d", before={"id": 1, "name": "a", "price": 1}, after=None),
    ]
    state = C.current_state(_parse(spark, texts, ROW), ["id", "name"], ["seq"])
    assert _rows(state) == [(1, "b", 1.0)]


def test_reinserted_row_is_current(spark):
    texts = [_event("c", before=None), _event("d", after=None), _event("c", before=None, after=OLD)]
    assert _rows(C.current_state(_parse(spark, texts, ROW), ["id"], ["seq"])) == [(1, "old", 1.5)]


def _table_at(events, ts_ms):
    table = {}
    for text in events:
        event = json.loads(text)
        if event["ts_ms"] > ts_ms:
            break
        if event["op"] == "d":
            del table[event["before"]["id"]]
        else:
            table[event["after"]["id"]] = event["after"]
    return table


@pytest.mark.parametrize("seed", [1, 2])
def test_snapshot_joined_to_changes_counts_each_change_once(spark, seed):
    events, final = _random_history(30, 600, seed)
    changes = _parse(spark, events, ROW)
    started = 40
    snapshot = spark.createDataFrame(list(_table_at(events, started).values()), ROW)
    union = C.snapshot_then_changes(snapshot, changes, "shop", "t", ["id"], ["ts_ms", "seq"], started)
    net = C.net_rows(C.retract(union), ["id", "name", "price"])
    assert {r.net for r in net.collect()} == {1} and _rows(net) == _expected(final)
    assert _rows(C.current_state(union, ["id"], ["ts_ms", "seq"])) == _expected(final)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_snapshot_read_while_rows_change_is_taken_back(spark, seed):
    events, final = _random_history(30, 600, seed)
    started, finished = 40, 80
    random.seed(seed)
    fuzzy = {}
    for key in range(30):
        row = _table_at(events, random.randint(started, finished)).get(key)
        if row is not None:
            fuzzy[key] = row
    changes = _parse(spark, events, ROW)
    snapshot = spark.createDataFrame(list(fuzzy.values()), ROW)
    union = C.snapshot_then_changes(
        snapshot, changes, "shop", "t", ["id"], ["ts_ms", "seq"], started, finished
    )
    net = C.net_rows(C.retract(union), ["id", "name", "price"])
    assert {r.net for r in net.collect()} == {1} and _rows(net) == _expected(final)
    start = union.where("op = 'r' and ts_ms = 40 and seq is null").select("after.*")
    assert _rows(start) == _expected(_table_at(events, started))


def test_declared_table_answers_sql(spark):
    texts = [_event("c", before=None), _event("u", before=NEW, after=OLD), _event("c", table="u")]
    P.declare_table(_feed(spark, texts), "declared", ROW, "shop", "t", ["id"], ["seq"])
    assert _rows(spark.sql("SELECT * FROM declared")) == [(1, "old", 1.5)]
    assert spark.sql("SELECT name FROM declared WHERE price > 9").isEmpty()


def test_declared_table_without_key_is_its_changelog(spark):
    texts = [_event("c", before=None), _event("u", before=NEW, after=OLD)]
    P.declare_table(_feed(spark, texts), "declared_log", ROW, "shop", "t")
    rows = spark.sql("SELECT * FROM declared_log").collect()
    assert [(r.added, r.name) for r in rows] == [(True, "new"), (False, "new"), (True, "old")]
