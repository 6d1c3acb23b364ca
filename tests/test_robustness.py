"""Records that are odd but must not get lost, whatever the session's settings."""

import json
from contextlib import contextmanager
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstream.functions.json_values import LENIENT, STRICT, normal_text
from siltstream.operators import changelog as C
from siltstream.operators import logs as L
from siltstream.plans import change_capture as P
from siltstream.plans.log_split import run_log_split, split_logs
from siltstream.sinks import topics as K
from siltstream.sources.files import read_landed
from siltstream.streaming.changelog import _folders, compact_current_state, read_current_state, start_current_state
from siltstream.streaming.first_seen import exact_order
from siltstream.streaming.job import JobOptions

from test_changelog import ROW, _event, _expected, _feed, _random_history, _rows

REPEATS = "spark.sql.variant.allowDuplicateKeys"


@contextmanager
def setting(spark, name, value):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


COMMON = '"common":{"mid":"m","is_new":"1"}'
ODD_LOGS = [
    "{" + COMMON + ',"a":1,"a":2,"page":{"p":1}}',
    "{" + COMMON + ',"start":{"x":1,"x":2}}',
    "{" + COMMON + ',"page":{"p":1,"p":2},"displays":[{"i":1}]}',
    '{"common":{"mid":"m","is_new":"1","is_new":"1"}}',
    "{" + COMMON + ',"a":null,"n":1234567890123456789012345678901234567890123456789012,"m":1.50}',
    "{" + COMMON + ',"a":"nullable","m":1e400,"w":[null, {"k":null}]}',
    "{" + COMMON + ',\n "page": {"p": null,\t"q": 1.50}}',
]


@pytest.mark.parametrize("allowed", ["true", "false"])
@pytest.mark.parametrize("mode", [STRICT, LENIENT])
def test_no_log_is_lost(spark, allowed, mode):
    rows = spark.createDataFrame(list(enumerate(ODD_LOGS)), "id long, value string")
    with setting(spark, REPEATS, allowed):
        routed = split_logs(rows, ["id"], mode=mode).collect()
    assert {r.id for r in routed} == set(range(len(ODD_LOGS)))
    for r in routed:
        assert r.value is not None
        if r.topic == L.DIRTY_TOPIC:
            assert r.value == ODD_LOGS[r.id]
        else:
            assert isinstance(json.loads(r.value), dict)
    if allowed == "true" and mode == STRICT:
        assert not [r for r in routed if r.topic == L.DIRTY_TOPIC]
        assert [r.topic for r in routed if r.id == 1] == [L.START_TOPIC]


def test_numbers_keep_their_characters(spark):
    texts = [ODD_LOGS[k] for k in (4, 5, 6)]
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    got = [r.text for r in rows.select(normal_text("value").alias("text")).collect()]
    assert got == [
        "{" + COMMON + ',"n":1234567890123456789012345678901234567890123456789012,"m":1.50}',
        "{" + COMMON + ',"a":"nullable","m":1e400,"w":[null,{}]}',
        "{" + COMMON + ',"page":{"q":1.50}}',
    ]


JSON = st.recursive(
    st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=4), v, max_size=3), max_leaves=8
)


def without_nulls(value):
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    return [without_nulls(v) for v in value] if isinstance(value, list) else value


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.text(max_size=4), JSON, max_size=4), min_size=20, max_size=40), st.sampled_from([None, 1]))
def test_null_members_go_and_nothing_else(spark, values, indent):
    rows = spark.createDataFrame([(k, json.dumps(v, indent=indent)) for k, v in enumerate(values)], "id int, value string")
    for r in rows.select("id", normal_text("value").alias("text")).collect():
        assert json.loads(r.text) == without_nulls(values[r.id])


PAGES = ['"{oops"', '"{\\"p\\":1} tail"', '"{\\"p\\":1,\\"q\\":null}"', '{"p":1}', "5", '"x"', "[1]", "null"]


def test_every_display_is_one_object(spark):
    texts = ["{" + COMMON + f',"page":{page},"displays":[{{"i":1}},2,"s",null]}}' for page in PAGES]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, value string")
    shown = split_logs(rows, ["id"]).where(F.col("topic") == L.DISPLAY_TOPIC).collect()
    pages = {}
    for r in shown:
        record = json.loads(r.value)
        assert isinstance(record, dict)
        pages[r.id] = record.get("page")
    assert pages == {0: None, 1: None, 2: {"p": 1}, 3: {"p": 1}, 4: None, 5: None, 6: None, 7: None}


@pytest.mark.parametrize("allowed", ["true", "false"])
def test_an_image_is_read_or_rejected(spark, allowed):
    image = '{"id":1,"id":2}'
    text = f'{{"before":null,"after":{image},"source":{{"db":"d","table":"t"}},"op":"c","ts_ms":1}}'
    with setting(spark, REPEATS, allowed):
        (row,) = P.database_records(spark.createDataFrame([(text,)], "value string")).collect()
    if allowed == "true":
        assert row.topic == C.CHANGE_TOPIC and json.loads(json.loads(row.value)["data"]) == {"id": 2}
    else:
        assert (row.topic, row.value) == (C.DIRTY_CHANGE_TOPIC, text)


def test_values_of_another_type_are_rejected(spark):
    images = [{"id": "x1"}, {"id": 3000000000}, {"id": "5"}, {"id": 6, "price": "dear"}, {"id": 7, "at": "no time"}, {"id": 8, "tags": [1, 2], "at": "2024-01-02 03:04:05"}]
    feed = _feed(spark, [_event("c", None, image) for image in images])
    row = "id int, price double, at timestamp, tags array<int>"
    changes = C.parse_changes(feed, row)
    assert {r.seq for r in changes.where("valid").collect()} == {2, 5}
    state = {r.id: r for r in C.current_state(changes, ["id"], ["seq"]).collect()}
    assert set(state) == {5, 8} and state[8].tags == [1, 2] and state[8]["at"] == datetime(2024, 1, 2, 3, 4, 5)
    assert {r.seq for r in P.rejected_events(feed, row).collect()} == {0, 1, 3, 4}


def test_changes_without_a_time_are_rejected(spark):
    feed = _feed(spark, [_event(ts_ms=5), _event(ts_ms=9), _event(ts_ms=None), "junk"])
    after = C.changes_after(C.parse_changes(feed), 5)
    assert {r.seq: r.valid for r in after.collect()} == {1: True, 2: False, 3: False}
    assert {r.seq: r.topic for r in C.route_changes(after).collect()}[2] == C.DIRTY_CHANGE_TOPIC


@pytest.mark.parametrize("typed", [True, False])
def test_full_read_feeds_the_capture(spark, typed):
    rows = spark.createDataFrame([(1, "a", 1.5)], ROW)
    changes = C.parse_changes(_feed(spark, [_event(ts_ms=9), _event(ts_ms=3)]), ROW if typed else None)
    events = C.snapshot_then_changes(rows, changes, "shop", "t", ["id"], ["ts_ms"], 5)
    records = [json.loads(r.value) for r in C.route_changes(events).collect()]
    assert sorted((r["type"], r["ts"]) for r in records) == [("insert", 5), ("update", 9)]
    assert {json.loads(r["data"])["name"] for r in records} == {"a", "new"}


# --- identity and order


def test_record_id_tells_exact_values_apart(spark):
    sql = """SELECT timestamp_micros(1730611800000000 + id) AS at, if(id = 2, NULL, id) AS n,
             if(id = 3, 'null', NULL) AS s FROM range(5)"""
    ids = {}
    for zone in ("UTC", "America/New_York"):
        with setting(spark, "spark.sql.session.timeZone", zone):
            rows = K.with_record_id(spark.sql(sql), ["at", "n", "s"])
            ids[zone] = [r.record_id for r in rows.orderBy("at").collect()]
    assert ids["UTC"] == ids["America/New_York"] and len(set(ids["UTC"])) == 5
    with pytest.raises(ValueError):
        K.with_record_id(spark.sql("SELECT array(1) AS a"), ["a"])


def test_order_columns_are_exact_in_python(spark):
    sql = """SELECT timestamp_micros(id) AS at, TIMESTAMP_NTZ'1970-01-01 00:00:00.000007' AS local,
             if(id = 1, NULL, id + 1152921504606846976) AS n, 'x' AS s, DATE'1970-01-03' AS d FROM range(2)"""
    rows = spark.sql(sql)
    got = rows.select(exact_order(rows, ["at", "local", "n", "s", "d"])).collect()
    assert tuple(got[0]) == (True, 0, True, 7, True, 1152921504606846976, True, "x", True, 2)
    assert tuple(got[1])[4:6] == (False, 0)


@pytest.mark.parametrize("case", ["repeated hour", "long numbers"])
def test_stream_and_batch_agree_on_the_first(spark, tmp_path, case):
    """The hour that New York has twice; numbers that a double cannot tell apart, next to NULL."""
    if case == "repeated hour":
        rows = spark.sql("SELECT timestamp_seconds(1730611800 + 2400 * id) AS at, id, 'm' AS mid FROM range(2)")
    else:
        rows = spark.sql("SELECT (1 << 60) + 1 - id AS at, id, if(id < 2, 'm', 'other') AS mid FROM range(2) UNION ALL SELECT NULL, 2, 'other'")
    text = F.format_string('{"common":{"mid":"%s","is_new":"1"}}', "mid").alias("value")
    with setting(spark, "spark.sql.session.timeZone", "America/New_York"):
        rows.select("at", "id", text).coalesce(1).write.parquet(f"{tmp_path}/in")
        batch = spark.read.parquet(f"{tmp_path}/in")
        stream = read_landed(spark, f"{tmp_path}/in", batch.schema, stream=True)
        run_log_split(stream, ["at", "id"], f"{tmp_path}/out", JobOptions(f"{tmp_path}/c", available_now=True))
        first = {r.id for r in spark.read.parquet(f"{tmp_path}/out").collect() if '"1"' in r.value}
        want = {r.id for r in split_logs(batch, ["at", "id"]).collect() if '"1"' in r.value}
    assert first == want == ({0} if case == "repeated hour" else {1, 2})


# --- applications


def test_applications_take_their_writer(spark):
    seen = []

    def write(records, job):
        seen.append((records.columns, job))

    run_log_split(spark.createDataFrame([(1, "x")], "id long, value string"), ["id"], write)
    P.run_database_capture(spark.createDataFrame([("x",)], "value string"), write)
    assert [columns[-1] for columns, _ in seen] == ["record_id", "value"] and seen[0][1] is None


def test_compaction_bounds_what_is_read(spark, tmp_path):
    events, table = _random_history(12, 90, seed=11)
    path, step = f"{tmp_path}/out", 9
    for part in range(10):
        rows = list(enumerate(events))[part * step : part * step + step]
        spark.createDataFrame(rows, "seq int, value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = read_landed(spark, f"{tmp_path}/in", "seq int, value string", stream=True, max_files=1)
    job = JobOptions(f"{tmp_path}/c", available_now=True)
    start_current_state(C.parse_changes(stream, ROW), ["id"], ["ts_ms", "seq"], job, path, compact_every=4)
    base, batches = _folders(spark, path)
    assert base == 7 and batches == [8, 9]
    assert _rows(read_current_state(spark, path, ["id"])) == _expected(table)
    # A compaction that was cut short is not taken, and the next one replaces it.
    (tmp_path / "out" / "base=9").mkdir()
    (tmp_path / "out" / "base=9" / "part-0.parquet").write_bytes(b"junk")
    assert _folders(spark, path)[0] == 7
    compact_current_state(spark, path, ["id"])
    assert _folders(spark, path) == (9, [])
    assert _rows(read_current_state(spark, path, ["id"])) == _expected(table)
