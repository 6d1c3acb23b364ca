"""Feeds in which rows change their keys, or that leave out old rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siltstream.operators import changelog as C
from siltstream.operators.chunked import range_of
from siltstream.operators.old_rows import with_old_rows
from siltstream.sources.files import read_landed
from siltstream.streaming.changelog import read_current_state, start_current_state
from siltstream.streaming.job import JobOptions

from test_changelog import ROW, _event, _expected, _feed, _parse, _rows

ORDER = ["ts_ms", "seq"]
COLUMNS = ["id", "name", "price"]
SCHEMA = "seq int, value string"


def moving_history(n_keys, n_events, seed, bare=False):
    """Events of which some give a row another key, the table after them, and the additions
    and retractions they mean. ``bare`` events hold no old row, or its key where it is
    needed; some rows are then deleted twice or created while they are there."""
    source = random.Random(seed)
    table, events, steps = {}, [], []

    def said(op, before, after, seq):
        if bare and before is not None:
            moved = after is not None and after["id"] != before["id"]
            before = {"id": before["id"]} if op == "d" or moved else None
        events.append(_event(op, before=before, after=after, ts_ms=seq // 7))

    def step(seq, added, row):
        steps.append((seq, added, row["id"], row["name"], row["price"]))

    for seq in range(n_events):
        key = 0 if source.random() < 0.34 else source.randrange(1, n_keys)
        old = table.get(key)
        row = {"id": key, "name": source.choice("ab"), "price": float(seq)}
        kind = source.random()
        if old is None and bare and kind < 0.2:
            said("d", {"id": key}, None, seq)
        elif old is None:
            said(source.choice("rc"), None, row, seq)
            step(seq, True, row)
            table[key] = row
        elif kind < 0.25:
            said("d", old, None, seq)
            step(seq, False, old)
            del table[key]
        elif kind < 0.5 and len(table) < n_keys:
            free = source.choice([k for k in range(n_keys) if k not in table])
            row["id"] = free
            said("u", old, row, seq)
            step(seq, False, old)
            step(seq, True, row)
            del table[key]
            table[free] = row
        else:
            said("c" if bare and kind > 0.9 else "u", old, row, seq)
            step(seq, False, old)
            step(seq, True, row)
            table[key] = row
    return events, table, sorted(steps)


def _steps(frame):
    return sorted((r.seq, r.added, r.id, r.name, r.price) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_current_state_and_net_rows_agree_on_changed_keys(spark, seed):
    events, table, steps = moving_history(25, 700, seed)
    changes = C.parse_changes(_feed(spark, events).repartition(5), ROW)
    assert _rows(C.current_state(changes, ["id"], ORDER)) == _expected(table)
    retracted = C.retract(changes)
    assert _rows(C.net_rows(retracted, COLUMNS)) == _expected(table)
    assert _steps(retracted) == steps


def test_an_update_of_one_key_stays_one_event(spark):
    texts = [_event("u"), _event("u", before=None), _event("u", before={"name": "x"}), _event("u", after=None)]
    rows = C.split_key_changes(_parse(spark, texts, ROW), ["id"]).orderBy("seq").collect()
    assert [(r.seq, r.op, r.step) for r in rows] == [(i, "u", 0) for i in range(4)]


def test_a_changed_key_is_a_delete_and_a_creation(spark):
    new = {"id": 2, "name": "new", "price": 1.0}
    (gone, made) = C.split_key_changes(_parse(spark, [_event(after=new)], ROW), ["id"]).orderBy("step").collect()
    assert (gone.op, gone.before.id, gone.after, gone.step) == ("d", 1, None, 0)
    assert (made.op, made.before, made.after.id, made.step) == ("c", None, 2, 1)


def test_part_of_a_key_may_change(spark):
    texts = [_event("c", before=None, after={"id": 1, "name": "a", "price": 1}),
             _event("u", before={"id": 1, "name": "a", "price": 1}, after={"id": 1, "name": "b", "price": 1})]
    state = C.current_state(_parse(spark, texts, ROW), ["id", "name"], ["seq"])
    assert _rows(state) == [(1, "b", 1.0)]


def _in_parts(spark, tmp_path, events, run, parts=3, seed=0):
    """Events land in order of their time in several parts, each in random order and with the
    stream stopped after it."""
    cuts = [len(events) * k // parts // 7 * 7 for k in range(parts)] + [len(events)]
    for a, b in zip(cuts, cuts[1:]):
        rows = list(enumerate(events))[a:b]
        random.Random(seed).shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = read_landed(spark, f"{tmp_path}/in", SCHEMA, stream=True)
        run(C.parse_changes(stream, ROW), JobOptions(f"{tmp_path}/checkpoint", available_now=True))


def test_current_state_stream_on_changed_keys(spark, tmp_path):
    events, table, _ = moving_history(20, 300, 3)
    _in_parts(
        spark, tmp_path, events, lambda c, job: start_current_state(c, ["id"], ORDER, job, f"{tmp_path}/out")
    )
    assert _rows(read_current_state(spark, f"{tmp_path}/out", ["id"])) == _expected(table)


@pytest.mark.parametrize("seed,ranges", [(1, None), (2, 1), (3, 50)])
def test_old_rows_are_supplied_in_batch(spark, seed, ranges):
    events, table, steps = moving_history(25, 700, seed, bare=True)
    changes = with_old_rows(C.parse_changes(_feed(spark, events).repartition(5), ROW), ["id"], ORDER, ranges)
    retracted = C.retract(changes)
    assert _steps(retracted) == steps
    assert _rows(C.net_rows(retracted, COLUMNS)) == _expected(table)
    assert _rows(C.current_state(changes, ["id"], [*ORDER, "step"])) == _expected(table)


def test_old_rows_of_a_feed_that_says_them_stay(spark):
    events, _, steps = moving_history(15, 200, 4)
    assert _steps(C.retract(with_old_rows(C.parse_changes(_feed(spark, events), ROW), ["id"], ORDER))) == steps


def test_old_rows_are_supplied_on_streams(spark, tmp_path):
    events, table, steps = moving_history(20, 350, 5, bare=True)

    def run(changes, job):
        rows = C.retract(with_old_rows(changes, ["id"], ORDER))
        job.start(rows.writeStream.format("parquet").option("path", f"{tmp_path}/out"))

    _in_parts(spark, tmp_path, events, run)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert _steps(out) == steps
    assert _rows(C.net_rows(out, COLUMNS)) == _expected(table)


def test_odd_events_get_no_old_rows(spark):
    texts = [
        _event("d", before=None, after=None),  # no key
        _event("d", before={"id": 9}, after=None),  # no such row
        _event("u", before=None, after=None),
        "junk",
        _event("x"),
        _event(None, before=None, after=OLD_ROW),
        _event(None, before=None, after={**OLD_ROW, "name": "b"}),
        _event("r", before=None, after={**OLD_ROW, "id": 7}),
    ]
    rows = with_old_rows(_parse(spark, texts, ROW), ["id"], ["seq"]).orderBy("seq").collect()
    assert [(r.seq, r.op, r.before and r.before.name) for r in rows] == [(5, "c", None), (6, "u", "a"), (7, "r", None)]
    empty = with_old_rows(_parse(spark, ["junk"], ROW), ["id"], ORDER)
    assert empty.collect() == []


OLD_ROW = {"id": 3, "name": "a", "price": 2.0}


def test_rows_with_parts_are_supplied_on_streams(spark, tmp_path):
    """Row images with nested and missing values come out of the state as they went in."""
    row = "id bigint, parts struct<a:int,b:array<string>>, at timestamp"
    image = {"id": 1, "parts": {"a": 5, "b": ["x", None]}, "at": "2024-01-02T03:04:05"}
    for k, event in enumerate([_event("c", before=None, after=image), _event("d", before={"id": 1}, after=None)]):
        spark.createDataFrame([(k, event)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        stream = read_landed(spark, f"{tmp_path}/in", SCHEMA, stream=True)
        supplied = with_old_rows(C.parse_changes(stream, row), ["id"], ["seq"])
        JobOptions(f"{tmp_path}/checkpoint", available_now=True).start(
            supplied.writeStream.format("parquet").option("path", f"{tmp_path}/out")
        )
    first, second = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    assert second.op == "d" and second.before == first.after
    assert first.after.parts.b == ["x", None]


def test_a_hot_key_is_cut_into_ranges(spark):
    """Of 4,000 events of one key no task gets more than a share."""
    events = [_event("c", before=None, after={"id": 1, "name": "a", "price": float(i)}, ts_ms=i) for i in range(4000)]
    changes = with_old_rows(_parse(spark, events, ROW), ["id"], ORDER, ranges=16)
    rows = changes.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in rows) == 4000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = with_old_rows(_parse(spark, events, ROW), ["id"], ORDER, ranges=64)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_range_of_counts_the_bounds_below(spark):
    for bounds in ([], [5], [1, 3, 3, 8], list(range(0, 100, 3))):
        values = [None, -1, 0, 1, 2, 3, 5, 8, 9, 50, 98, 99, 200]
        rows = spark.createDataFrame([(v,) for v in values], "v int").select("v", range_of(F.col("v"), bounds).alias("n"))
        assert [r.n for r in rows.collect()] == [0 if v is None else sum(b <= v for b in bounds) for v in values]


def test_events_say_their_key_in_json():
    assert json.loads(_event("d", before={"id": 9}, after=None))["before"] == {"id": 9}


def test_keys_share_states_on_streams(spark, tmp_path, monkeypatch):
    """The state store is asked once per group of keys, not once per key, and no row is mixed up."""
    from siltstream.streaming import old_rows

    monkeypatch.setattr(old_rows, "GROUPS", 4)
    events, table, steps = moving_history(60, 500, 8, bare=True)
    seen = []

    def run(changes, job):
        rows = C.retract(with_old_rows(changes, ["id"], ORDER))
        query = job.start(rows.writeStream.format("parquet").option("path", f"{tmp_path}/out"))
        seen.extend(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators)

    _in_parts(spark, tmp_path, events, run)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert _steps(out) == steps and _rows(C.net_rows(out, COLUMNS)) == _expected(table)
    assert 0 < max(seen) <= 4
