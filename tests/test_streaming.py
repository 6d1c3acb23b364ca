import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siltstream.operators import changelog as C
from siltstream.operators import logs as L
from siltstream.plans.change_capture import run_database_capture
from siltstream.plans.log_split import run_log_split, split_logs
from siltstream.sources.files import read_landed, read_lines
from siltstream.streaming.changelog import clean_current_state, read_current_state, start_current_state
from siltstream.streaming import first_seen
from siltstream.streaming.first_seen import FirstSeenProcessor
from siltstream.streaming.job import JobOptions

from test_changelog import ROW, _expected, _feed, _random_history, _rows
from test_logs import _brute_force, _log

SCHEMA = "id long, value string"


def _job(tmp_path, **options):
    return JobOptions(f"{tmp_path}/checkpoint", available_now=True, **options)


def _land(spark, tmp_path, rows, schema=SCHEMA, files=1):
    frame = spark.createDataFrame(rows, schema).repartition(files)
    frame.write.mode("append").parquet(f"{tmp_path}/in")


def _device_logs(n, seed, first_id=0):
    random.seed(seed)
    return [
        (first_id + i, "hot" if random.random() < 0.4 else f"m{random.randrange(60)}", random.choice("011"))
        for i in range(n)
    ]


def _texts(logs):
    return [(i, _log(mid, flag, displays=[i])) for i, mid, flag in logs]


def _run_split(spark, tmp_path, **options):
    stream = read_landed(spark, f"{tmp_path}/in", SCHEMA, stream=True)
    run_log_split(stream, ["id"], f"{tmp_path}/out", _job(tmp_path), **options)
    return spark.read.parquet(f"{tmp_path}/out")


def _page_flags(routed):
    pages = routed.where(F.col("topic") == L.PAGE_TOPIC)
    return {r.id: json.loads(r.value)["common"]["is_new"] for r in pages.collect()}


def test_restarted_stream_equals_batch(spark, tmp_path):
    """Three arrivals, the stream stopped after each; the first file set has many files."""
    logs = _device_logs(900, seed=1)
    for part in range(3):
        arrived = random.sample(logs[part * 300 : part * 300 + 300], 300)
        _land(spark, tmp_path, _texts(arrived), files=3)
        routed = _run_split(spark, tmp_path)
    assert _page_flags(routed) == _brute_force(logs)
    batch = split_logs(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in"), ["id"])
    columns = ["id", "topic", "position", "value", "record_id"]
    streamed = routed.select(columns)
    assert streamed.exceptAll(batch.select(columns)).isEmpty()
    assert batch.select(columns).exceptAll(streamed).isEmpty()


def test_many_arrow_batches_of_a_hot_device(spark, tmp_path):
    """Small Arrow batches give a device many candidates; the answer stays the same."""
    logs = _device_logs(600, seed=2)
    _land(spark, tmp_path, _texts(random.sample(logs, 600)), files=4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _page_flags(_run_split(spark, tmp_path)) == _brute_force(logs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_earlier_arrival_comes_first_whatever_its_order_column(spark, tmp_path):
    _land(spark, tmp_path, _texts([(9, "m", "1")]))
    _run_split(spark, tmp_path)
    _land(spark, tmp_path, _texts([(1, "m", "1")]))
    assert _page_flags(_run_split(spark, tmp_path)) == {9: "1", 1: "0"}


def test_dirty_rows_pass_the_stateful_operator(spark, tmp_path):
    rows = [(0, "x"), (1, "{"), (2, _log()), (3, '{"common":{"is_new":"1"}}'), (4, None)]
    _land(spark, tmp_path, rows)
    routed = _run_split(spark, tmp_path)
    dirty = {r.id: r.value for r in routed.where(F.col("topic") == L.DIRTY_TOPIC).collect()}
    assert dirty == {0: "x", 1: "{", 3: '{"common":{"is_new":"1"}}', 4: None}


def test_seen_devices_with_time_to_live(spark, tmp_path):
    _land(spark, tmp_path, _texts([(0, "m", "1"), (1, "m", "1")]))
    with pytest.raises(ValueError):
        _run_split(spark, tmp_path, ttl_ms=3_600_000)
    stream = read_landed(spark, f"{tmp_path}/in", SCHEMA, stream=True)
    job = JobOptions(f"{tmp_path}/checkpoint", interval_ms=200)
    query = run_log_split(stream, ["id"], f"{tmp_path}/out", job, ttl_ms=3_600_000)
    try:
        deadline = time.time() + 60
        while not any(p["numInputRows"] for p in query.recentProgress):
            assert query.exception() is None and time.time() < deadline
            time.sleep(0.2)
    finally:
        query.stop()
    assert _page_flags(spark.read.parquet(f"{tmp_path}/out")) == {0: "1", 1: "0"}


def test_processor_orders_missing_positions_first():
    positions = [(2, "a"), (None, "b"), (1, None), (1, "a")]
    ordered = sorted(positions, key=lambda p: FirstSeenProcessor._position(
        type("P", (), {"_order": [0, 1]})(), p))
    assert ordered == [(None, "b"), (1, None), (1, "a"), (2, "a")]


class _Flags:
    """The state of the first-seen rule, and how often it was asked."""

    def __init__(self):
        self.seen, self.group, self.calls = {}, None, 0

    def getMapState(self, *_, **__):
        return self

    def containsKey(self, key):
        self.calls += 1
        return key in self.seen.setdefault(self.group, {})

    def updateValue(self, key, value):
        self.calls += 1
        self.seen[self.group][key] = value


def test_rows_reach_the_state_packed():
    """Two micro-batches of 20,000 rows of 300 devices: some hundred packed rows each, the
    state is asked per device and not per row, and every row comes back with its flag."""
    rng, flags, known = random.Random(5), _Flags(), set()
    for part in range(2):
        devices = [rng.choice([None, "hot", f"m{rng.randrange(300 + part)}"]) for _ in range(20_000)]
        rows = pa.RecordBatch.from_pydict({
            "id": list(range(20_000)), "mid": devices, "_known0": [True] * 20_000, "_value0": rng.sample(range(20_000), 20_000),
            "_key": devices, "_group": [None if d is None else hash(d) % 64 for d in devices], "_spread": [3] * 20_000,
        })
        batches = [rows.slice(at, 500) for at in range(0, 20_000, 500)]
        packed = [r for b in first_seen._pack(2, ["_known0", "_value0"])(iter(batches)) for r in b.to_pylist()]
        assert len(packed) <= 64 + first_seen._PARTS
        processor, flags.calls, out = FirstSeenProcessor(["_known0", "_value0"]), 0, []
        processor.init(flags)
        for group in {r["_group"] for r in packed}:
            flags.group = group
            mine = [Row(**r) for r in packed if r["_group"] == group]
            out += [r.asDict() for r in processor.handleInputRows((group,), iter(mine), None)]
        names = sorted({d for d in devices if d})
        assert flags.calls <= 2 * len(names)
        back = pa.Table.from_batches(first_seen._unpack([pa.RecordBatch.from_pylist(out)])).to_pylist()
        position = rows.column("_value0").to_pylist()
        want = {min((position[i], i) for i in range(20_000) if devices[i] == d)[1] for d in names if d not in known}
        assert {r["id"] for r in back if r["first_seen"]} == want
        assert sorted((r["id"], r["mid"]) for r in back) == sorted(zip(range(20_000), devices), key=lambda r: r[0])
        known.update(names)


@pytest.mark.parametrize("kind", ["timestamp", "double", "struct<a:long>", "decimal(20,3)"])
def test_keys_of_other_types_are_seen_once(spark, tmp_path, kind):
    values = {
        "timestamp": "timestamp_micros(id % 7)", "double": "if(id % 2 = 0, 0.0D, -0.0D) + id % 7",
        "struct<a:long>": "named_struct('a', id % 7)", "decimal(20,3)": "cast((id % 7) / 8 AS decimal(20,3))",
    }
    rows = spark.range(200).selectExpr("id", f"if(id = 3, NULL, {values[kind]}) AS k", "array(id) AS more")
    for part in (rows.where("id < 100"), rows.where("id >= 100")):
        part.repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = read_landed(spark, f"{tmp_path}/in", rows.schema, stream=True)
        marked = first_seen.mark_first_seen_stream(stream, ["id"], key="k")
        _job(tmp_path).start(marked.writeStream.format("parquet").option("path", f"{tmp_path}/out"))
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {r.id for r in out.where("first_seen").collect()} == {0, 1, 2, 4, 5, 6, 10}
    assert sorted(out.drop("first_seen").collect()) == sorted(rows.collect(), key=lambda r: r.id)


def test_retract_stream_equals_batch(spark, tmp_path):
    events, _ = _random_history(20, 200, seed=4)
    rows = list(enumerate(events))
    for part in (rows[:120], rows[120:]):
        _land(spark, tmp_path, part, "seq int, value string", files=2)
        stream = read_landed(spark, f"{tmp_path}/in", "seq int, value string", stream=True)
        retracted = C.retract(C.parse_changes(stream, ROW))
        writer = retracted.writeStream.format("parquet").option("path", f"{tmp_path}/out")
        _job(tmp_path).start(writer)
    streamed = spark.read.parquet(f"{tmp_path}/out")
    batch = C.retract(C.parse_changes(_feed(spark, events), ROW))
    assert sorted(map(repr, streamed.collect())) == sorted(map(repr, batch.collect()))


def _run_current(spark, tmp_path, **target):
    stream = read_landed(
        spark, f"{tmp_path}/in", "seq int, value string", stream=True, max_files=1
    )
    changes = C.parse_changes(stream, ROW)
    start_current_state(changes, ["id"], ["ts_ms", "seq"], _job(tmp_path), **target)


def test_current_state_stream_over_many_batches(spark, tmp_path):
    events, table = _random_history(25, 400, seed=6)
    rows = random.sample(list(enumerate(events)), len(events))
    for part in (rows[:250], rows[250:]):
        _land(spark, tmp_path, part, "seq int, value string", files=3)
        _run_current(spark, tmp_path, path=f"{tmp_path}/out")
    assert _rows(read_current_state(spark, f"{tmp_path}/out", ["id"])) == _expected(table)


def test_current_state_can_be_upserted_elsewhere(spark, tmp_path):
    events, table = _random_history(10, 60, seed=7)
    _land(spark, tmp_path, list(enumerate(events)), "seq int, value string", files=2)
    content = {}

    def upsert(rows, batch_id):
        for r in rows.collect():
            content[r.id] = None if r.op == "d" else r.after.asDict()

    _run_current(spark, tmp_path, write_batch=upsert)
    assert sorted(k for k, v in content.items() if v) == sorted(table)
    with pytest.raises(ValueError):
        _run_current(spark, tmp_path)


def test_superfluous_folders_of_a_running_table_can_go(spark, tmp_path):
    events, table = _random_history(15, 90, seed=9)
    out = f"{tmp_path}/out"
    for part in range(6):
        _land(spark, tmp_path, list(enumerate(events))[part * 15 : part * 15 + 15], "seq int, value string")
    _run_current(spark, tmp_path, path=out, compact_every=2)
    assert clean_current_state(spark, out, keep_bases=4) == []
    assert sorted(clean_current_state(spark, out, keep_bases=2)) == ["base=1", "batch=0", "batch=1", "batch=2", "batch=3"]
    assert _rows(read_current_state(spark, out, ["id"])) == _expected(table)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["base=3", "base=5", "batch=4", "batch=5"]
    with pytest.raises(ValueError):
        clean_current_state(spark, out, keep_bases=0)


def test_capture_stream_routes_to_topics(spark, tmp_path):
    events, _ = _random_history(5, 20, seed=8)
    frame = spark.createDataFrame([(e,) for e in [*events, "junk"]], "value string")
    frame.write.text(f"{tmp_path}/in")
    feed = read_lines(spark, f"{tmp_path}/in", stream=True)
    run_database_capture(feed, f"{tmp_path}/out", _job(tmp_path))
    counts = spark.read.parquet(f"{tmp_path}/out").groupBy("topic").count().collect()
    assert {r.topic: r["count"] for r in counts} == {C.CHANGE_TOPIC: 20, C.DIRTY_CHANGE_TOPIC: 1}
