"""A table read in chunks at different times, joined to its running feed."""

import json
import random

import pytest

from siltstream.operators import changelog as C
from siltstream.operators.chunked import KeyChunks, chunks_then_changes, plan_chunks
from siltstream.sources.files import read_landed
from siltstream.streaming.chunked import read_chunked_capture, start_chunked_capture
from siltstream.streaming.job import JobOptions

from test_changelog import ROW, _event, _expected, _parse, _rows
from test_key_changes import COLUMNS, ORDER, SCHEMA, moving_history

CHUNKS = KeyChunks("id", (5, 10, 15))
MARKS = "chunk int, low bigint, high bigint"


def table_at(events, ts_ms):
    table = {}
    for text in events:
        event = json.loads(text)
        if event["ts_ms"] > ts_ms:
            break
        if event["before"] is not None:
            table.pop(event["before"]["id"], None)
        if event["op"] != "d":
            table[event["after"]["id"]] = event["after"]
    return table


def chunk_number(key):
    return sum(b <= key for b in CHUNKS.bounds)


def read_slowly(events, chunk, low, high, source):
    """Rows of a chunk, each as of some time between its marks."""
    rows = {}
    for key in range(25):
        row = table_at(events, source.randint(low, high)).get(key)
        if chunk_number(key) == chunk and row is not None:
            rows[key] = row
    return list(rows.values())


def expected_changelog(events, marks):
    """Snapshot rows at the high marks, and (seq, op, key) of the events after them."""
    snapshot, later = [], []
    for chunk, (_, high) in enumerate(marks):
        snapshot += [(high, r["id"], r["name"], r["price"]) for r in table_at(events, high).values() if chunk_number(r["id"]) == chunk]
    for seq, text in enumerate(events):
        e = json.loads(text)
        old, new = (e[k] and e[k]["id"] for k in ("before", "after"))
        moved = e["op"] == "u" and old != new
        for op, key in [("d", old), ("c", new)] if moved else [(e["op"], old if e["op"] == "d" else new)]:
            if e["ts_ms"] > marks[chunk_number(key)][1]:
                later.append((seq, op, key))
    return sorted(snapshot), sorted(later)


def check(out, events, marks, table):
    rows = out.collect()
    snapshot, later = expected_changelog(events, marks)
    taken = [r for r in rows if r.seq is None]
    assert sorted((r.ts_ms, r.after.id, r.after.name, r.after.price) for r in taken) == snapshot
    assert {r.op for r in taken} <= {"r"}
    assert sorted((r.seq, r.op, (r.after or r.before).id) for r in rows if r.seq is not None) == later
    net = C.net_rows(C.retract(out), COLUMNS)
    assert {r.net for r in net.collect()} <= {1} and _rows(net) == _expected(table)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chunks_of_different_times_give_the_exact_changelog(spark, seed):
    events, table, _ = moving_history(25, 700, seed)
    source = random.Random(seed)
    marks = [(low, low + source.randrange(25)) for low in (source.randrange(75) for _ in range(4))]
    rows = [r for c, (low, high) in enumerate(marks) for r in read_slowly(events, c, low, high, source)]
    out = chunks_then_changes(
        spark.createDataFrame(rows, ROW),
        spark.createDataFrame([(c, *m) for c, m in enumerate(marks)], MARKS),
        _parse(spark, events, ROW),
        "shop",
        "t",
        ["id"],
        ORDER,
        CHUNKS,
    )
    check(out, events, marks, table)


def test_chunks_without_marks_give_nothing(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (7, "b", 2.0)], ROW)
    marks = spark.createDataFrame([(0, 5, 6)], MARKS)
    changes = _parse(spark, [_event("c", before=None, after={"id": k, "name": "n", "price": 1}) for k in (2, 8)], ROW)
    out = chunks_then_changes(rows, marks, changes, "shop", "t", ["id"], ORDER, CHUNKS)
    assert sorted((r.op, r.after.id) for r in out.collect()) == [("c", 2), ("r", 1)]


def test_empty_tables_and_feeds(spark):
    none = spark.createDataFrame([], ROW)
    marks = spark.createDataFrame([(0, 5, 6)], MARKS)
    junk = _parse(spark, ["junk"], ROW)
    assert chunks_then_changes(none, marks, junk, "shop", "t", ["id"], ORDER, CHUNKS).collect() == []
    rows = spark.createDataFrame([(None, "a", 1.0), (1, "b", 1.0)], ROW)
    out = chunks_then_changes(rows, marks, junk, "shop", "t", ["id"], ORDER, CHUNKS)
    assert sorted(r.after.name for r in out.collect()) == ["a", "b"]


def test_conditions_cut_a_table_into_its_chunks(spark):
    rows = spark.createDataFrame([(k, "a", 1.0) for k in [None, *range(-3, 30)]], ROW)
    parts = [rows.where(CHUNKS.condition(c)).collect() for c in range(len(CHUNKS))]
    assert sum(map(len, parts)) == rows.count()
    for c, part in enumerate(parts):
        assert {0 if r.id is None else chunk_number(r.id) for r in part} == {c}
    assert spark.range(4).where(KeyChunks("id", ()).condition(0)).count() == 4


def test_planned_chunks_are_about_equal(spark):
    rows = spark.range(10_000).selectExpr("id * id AS id")
    chunks = plan_chunks(rows, "id", 8)
    sizes = [rows.where(chunks.condition(c)).count() for c in range(len(chunks))]
    assert len(sizes) == 8 and max(sizes) < 1400
    assert plan_chunks(rows.limit(0), "id", 8).bounds == () and len(plan_chunks(rows, "id", 1)) == 1


class Database:
    """The table behind the feed: reading takes time, while the feed goes on."""

    def __init__(self, spark, events, seed, fail_at=None):
        self.spark, self.events, self.source = spark, events, random.Random(seed)
        self.now, self.marks, self.fail_at = 0, {}, fail_at

    def read(self, chunk):
        if chunk == self.fail_at:
            self.fail_at = None
            raise RuntimeError("the database went away")
        low = self.now
        self.now += self.source.randrange(1, 12)
        self.marks[chunk] = (low, self.now)
        rows = read_slowly(self.events, chunk, low, self.now, self.source)
        return self.spark.createDataFrame(rows, ROW)


def capture(spark, tmp_path, events, database, parts=7, per_batch=1):
    """The feed lands a part at a time; between parts a chunk is read."""
    for k in range(parts):
        rows = [(i, e) for i, e in enumerate(events) if json.loads(e)["ts_ms"] * parts // 100 == k]
        random.Random(k).shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        database.now = max(database.now, max(json.loads(e)["ts_ms"] for _, e in rows))

        def run():
            stream = read_landed(spark, f"{tmp_path}/in", SCHEMA, stream=True, max_files=1)
            start_chunked_capture(
                C.parse_changes(stream, ROW), "shop", "t", ["id"], ORDER, CHUNKS, database.read, lambda: database.now,
                JobOptions(f"{tmp_path}/checkpoint", available_now=True), f"{tmp_path}/out", per_batch,
            )

        try:
            run()
        except Exception:
            if database.fail_at is not None:
                raise
            run()
    return read_chunked_capture(spark, f"{tmp_path}/out")


@pytest.mark.parametrize("seed,fail_at,per_batch", [(1, None, 1), (2, 2, 1), (3, 1, 2)])
def test_chunks_read_beside_a_running_feed(spark, tmp_path, seed, fail_at, per_batch):
    """With ``fail_at`` a reading fails and its micro-batch is run again."""
    events, table, _ = moving_history(25, 700, seed)
    database = Database(spark, events, seed, fail_at)
    out = capture(spark, tmp_path, events, database, per_batch=per_batch)
    check(out, events, [database.marks[c] for c in range(4)], table)
