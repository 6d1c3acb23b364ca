"""Reading a table in chunks while its change feed runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstream.operators import changelog as C
from siltstream.operators.chunked import (
    MARKS,
    KeyChunks,
    between_marks,
    caught_up,
    event_columns,
    keyed_events,
    snapshot_of,
)
from siltstream.streaming.changelog import complete_folders
from siltstream.streaming.job import JobOptions

_STATE = f"{MARKS}, read_in bigint, joined_in bigint, reached bigint"


@dataclass(frozen=True)
class Mark:
    """A chunk that was read: the feed's positions around the reading, the micro-batch it was
    read in, and the one in which its rows went out."""

    chunk: int
    low: int
    high: int
    read_in: int
    joined_in: int | None = None


class ChunkedCapture:
    """One capture job; see :func:`start_chunked_capture`.

    Below ``path``: ``changes/batch=n`` with the events that go out, ``held/batch=n`` with
    events between the marks of chunks that wait, ``rows/chunk=n`` with rows as read, and
    ``state/batch=n`` with the marks of all chunks read so far. A micro-batch that is run
    again starts from the state of the one before and replaces what it wrote.
    """

    def __init__(
        self,
        path: str,
        database: str,
        table: str,
        keys: Sequence[str],
        order: Sequence[str],
        chunks: KeyChunks,
        read_chunk: Callable[[int], DataFrame],
        position_now: Callable[[], int],
        chunks_per_batch: int,
    ):
        self.path, self.database, self.table = path, database, table
        self.keys, self.order, self.position = list(keys), list(order), order[0]
        self.chunks, self.read_chunk, self.position_now = chunks, read_chunk, position_now
        self.chunks_per_batch = chunks_per_batch

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks, reached = self.state_before(spark, batch_id)
        # The events are used several times, and a repeated reading must see the same ones.
        batch = batch.persist()
        try:
            top = batch.agg(F.max(self.position)).first()[0]
            reached = max((p for p in (reached, top) if p is not None), default=None)
            self.pass_on(batch, batch_id, marks, reached)
        finally:
            batch.unpersist()
        if reached is not None:
            marks = [
                Mark(m.chunk, m.low, m.high, m.read_in, batch_id)
                if m.joined_in is None and reached > m.high
                else m
                for m in marks
            ]
            done = len(marks)
            for chunk in range(done, min(done + self.chunks_per_batch, len(self.chunks))):
                marks.append(self.read(chunk, batch_id, reached))
        self.save_state(spark, batch_id, marks, reached)

    def pass_on(self, batch: DataFrame, batch_id: int, marks: list[Mark], reached: int | None) -> None:
        """Write the events that go out, and those that wait for their chunk's rows."""
        spark = batch.sparkSession
        selected = C.select_tables(batch, self.database, self.table)
        events = keyed_events(selected, self.keys, self.chunks)
        known = self.frame(spark, marks)
        held, later = between_marks(events, known, self.position)
        waiting = [m for m in marks if m.joined_in is None]
        due = [m for m in waiting if reached is not None and reached > m.high]
        out = event_columns(later)
        if waiting:
            held.write.mode("overwrite").parquet(f"{self.path}/held/batch={batch_id}")
        if due:
            since = min(m.read_in for m in due)
            folders = [n for n in complete_folders(spark, f"{self.path}/held", "batch") if since < n <= batch_id]
            parts = [spark.read.parquet(f"{self.path}/held/batch={n}") for n in folders]
            ready = self.frame(spark, due)
            all_held = reduce(DataFrame.unionByName, parts)
            mine = all_held.join(ready.select("chunk"), F.col("_chunk") == F.col("chunk"), "left_semi")
            rows = reduce(DataFrame.unionByName, [self.rows(spark, m.chunk) for m in due])
            current = caught_up(rows, mine, self.keys, self.order)
            snapshot = snapshot_of(current, ready, self.database, self.table, self.position)
            out = snapshot.unionByName(out, allowMissingColumns=True)
        out.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")

    def read(self, chunk: int, batch_id: int, reached: int) -> Mark:
        """Read one chunk; all events up to ``reached`` were there before."""
        rows = self.read_chunk(chunk)
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/chunk={chunk}")
        return Mark(chunk, reached, max(reached, self.position_now()), batch_id)

    def rows(self, spark: SparkSession, chunk: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows/chunk={chunk}").withColumn("_chunk", F.lit(chunk))

    @staticmethod
    def frame(spark: SparkSession, marks: list[Mark]) -> DataFrame:
        return spark.createDataFrame([(m.chunk, m.low, m.high) for m in marks], MARKS)

    def state_before(self, spark: SparkSession, batch_id: int) -> tuple[list[Mark], int | None]:
        earlier = [n for n in complete_folders(spark, f"{self.path}/state", "batch") if n < batch_id]
        if not earlier:
            return [], None
        rows = spark.read.schema(_STATE).parquet(f"{self.path}/state/batch={max(earlier)}").collect()
        # The row without a chunk says how far the feed was read.
        reached = next(r.reached for r in rows if r.chunk is None)
        marks = [Mark(r.chunk, r.low, r.high, r.read_in, r.joined_in) for r in rows if r.chunk is not None]
        return sorted(marks, key=lambda m: m.chunk), reached

    def save_state(self, spark: SparkSession, batch_id: int, marks: list[Mark], reached: int | None) -> None:
        rows = [(m.chunk, m.low, m.high, m.read_in, m.joined_in, None) for m in marks]
        rows.append((None, None, None, None, None, reached))
        state = spark.createDataFrame(rows, _STATE).coalesce(1)
        state.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")


def start_chunked_capture(
    changes: DataFrame,
    database: str,
    table: str,
    keys: Sequence[str],
    order: Sequence[str],
    chunks: KeyChunks,
    read_chunk: Callable[[int], DataFrame],
    position_now: Callable[[], int],
    options: JobOptions,
    path: str,
    chunks_per_batch: int = 1,
) -> StreamingQuery:
    """Capture a table from its full content on while it changes, without one consistent read.

    ``changes`` are the typed events of a feed. Each micro-batch passes its events on and then
    reads the next ``chunks_per_batch`` chunks: ``read_chunk(n)`` gives the rows that
    ``chunks.condition(n)`` selects, with the columns of the row images, and ``position_now()``
    the position of the feed at that time, in the first column of ``order``. A chunk's rows go
    out, brought up to its high mark, as soon as the feed has passed that mark; until then
    events of its keys wait. Events of chunks that were not read yet are left out, for the
    reading will show them. :func:`read_chunked_capture` reads what went out: the exact
    changelog, as :func:`~siltstream.operators.chunked.chunks_then_changes` gives it.

    The feed must deliver positions in order from one micro-batch to the next; inside one
    they may come in any order. Every event of the feed moves it on, of other tables too; a
    feed that falls silent needs heartbeats for the last chunks to go out. The marks, a row
    per chunk, pass through the driver; rows and events do not. Rejected events are those of
    :func:`~siltstream.plans.change_capture.rejected_events`.
    """
    capture = ChunkedCapture(
        path, database, table, keys, order, chunks, read_chunk, position_now, chunks_per_batch
    )
    return options.start(changes.writeStream.foreachBatch(capture))


def read_chunked_capture(spark: SparkSession, path: str) -> DataFrame:
    """The changelog written so far by :func:`start_chunked_capture`."""
    batches = complete_folders(spark, f"{path}/changes", "batch")
    parts = [spark.read.parquet(f"{path}/changes/batch={n}") for n in batches]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
