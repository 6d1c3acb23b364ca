"""A full read of a table in chunks of its key, joined to the changes around each read.

A chunk is read at some time between two marks of the feed, its low and its high position.
Rows of the chunk yield to the events between the marks; what comes after the high mark
follows as changes. So every key has one snapshot row, as of its chunk's high mark, and each
later event once, however far apart the chunks were read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.functions import change_images as I
from siltstream.operators import changelog as C

#: Columns of the marks of chunks that were read.
MARKS = "chunk int, low bigint, high bigint"


def range_of(value: Column, bounds: Sequence[Any]) -> Column:
    """How many of the rising ``bounds`` are not above the value, found by halving; a missing
    value counts as the least."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*map(F.lit, bounds))
    halves = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]

    def move(at: Column, half: Column) -> Column:
        return F.when(F.get(listed, at + half - 1) <= value, at + half).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), move)


@dataclass(frozen=True)
class KeyChunks:
    """Chunks of a table: ranges of its column ``key`` between rising ``bounds``."""

    key: str
    bounds: tuple

    def __len__(self) -> int:
        return len(self.bounds) + 1

    def number(self, key: Column) -> Column:
        return range_of(key, self.bounds)

    def condition(self, chunk: int) -> Column:
        """The rows of one chunk, as plain comparisons that a source can push down."""
        key, last = F.col(self.key), len(self.bounds)
        if not last:
            return F.lit(True)
        if chunk == 0:
            return (key < F.lit(self.bounds[0])) | key.isNull()
        from_here = key >= F.lit(self.bounds[chunk - 1])
        return from_here if chunk == last else from_here & (key < F.lit(self.bounds[chunk]))


def plan_chunks(rows: DataFrame, key: str, count: int, accuracy: int = 10_000) -> KeyChunks:
    """About ``count`` chunks of equal size, by approximate quantiles of a numeric key."""
    shares = [k / count for k in range(1, count)]
    if not shares:
        return KeyChunks(key, ())
    found = rows.agg(F.percentile_approx(key, shares, accuracy)).first()[0] or []
    return KeyChunks(key, tuple(sorted(set(found))))


def keyed_events(changes: DataFrame, keys: Sequence[str], chunks: KeyChunks) -> DataFrame:
    """Events about one key each, with ``_chunk`` and the key as ``_key_...``."""
    names = [f"_key_{key}" for key in keys]
    events = C.split_key_changes(changes, keys)
    named = events.select(
        "*", *[column.alias(name) for column, name in zip(C.key_columns(keys), names)]
    )
    return named.withColumn("_chunk", chunks.number(F.col(f"_key_{chunks.key}")))


def caught_up(
    rows: DataFrame, held: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Rows of chunks as they were at the chunks' high marks.

    ``rows`` has the table's columns and ``_chunk``; ``held`` the keyed events between the
    marks. The last event of a key decides; keys without one keep their row. Events are
    combined before the shuffle, so a hot key costs no more than any other.
    """
    columns = [name for name in rows.columns if name != "_chunk"]
    names = [f"_key_{key}" for key in keys]
    last = F.max_by(F.struct("op", "after"), F.struct(*order, "step")).alias("_last")
    touched = held.groupBy("_chunk", *names).agg(last)
    read = rows.select(
        "_chunk",
        *[F.col(key).alias(name) for key, name in zip(keys, names)],
        F.struct(*columns).alias("_row"),
    )
    both = read.join(touched, ["_chunk", *names], "full_outer")
    now = F.struct(
        *[
            F.col("_last.after").getField(f.name).cast(f.dataType).alias(f.name)
            for f in rows.select(*columns).schema.fields
        ]
    )
    alive = F.col("_last.after").isNotNull() & ~F.col("_last.op").eqNullSafe(I.DELETE)
    row = F.when(F.col("_last").isNull(), F.col("_row")).when(alive, now)
    return both.select("_chunk", row.alias("_row")).where(F.col("_row").isNotNull())


def snapshot_of(
    chunk_rows: DataFrame, marks: DataFrame, database: str, table: str, position: str
) -> DataFrame:
    """Rows of :func:`caught_up` as typed snapshot events at their chunk's high mark."""
    placed = chunk_rows.join(marks, chunk_rows["_chunk"] == marks["chunk"])
    events = placed.select(
        F.lit(None).cast("string").alias("value"),
        F.lit(True).alias("valid"),
        F.lit(None).cast(chunk_rows.schema["_row"].dataType).alias("before"),
        F.col("_row").alias("after"),
        F.lit(database).alias("db"),
        F.lit(table).alias("table"),
        F.lit(I.SNAPSHOT).alias("op"),
        F.col("high").alias("ts_ms"),
        F.lit(0).alias("step"),
    )
    return events if position == "ts_ms" else events.withColumn(position, F.col("ts_ms"))


def between_marks(events: DataFrame, marks: DataFrame, position: str) -> tuple[DataFrame, DataFrame]:
    """Keyed events between the marks of their chunk, and those after them. Events before the
    low mark are in the rows read, so they are in neither."""
    placed = events.join(marks, events["_chunk"] == marks["chunk"])
    at = F.col(position)
    held = placed.where((at > F.col("low")) & (at <= F.col("high")))
    later = placed.where(at > F.col("high"))
    return held.select(*events.columns), later.select(*events.columns)


def event_columns(events: DataFrame) -> DataFrame:
    """Events without the working columns."""
    return events.drop(*[name for name in events.columns if name.startswith("_key_")], "_chunk")


def chunks_then_changes(
    rows: DataFrame,
    marks: DataFrame,
    changes: DataFrame,
    database: str,
    table: str,
    keys: Sequence[str],
    order: Sequence[str],
    chunks: KeyChunks,
) -> DataFrame:
    """The exact changelog of a table that was read in chunks at different times.

    ``rows`` are the rows of all chunks together; ``marks`` has a row ``(chunk, low, high)``
    per chunk: positions, in the first column of ``order``, of the feed before and after the
    chunk was read. ``changes`` are typed events recorded from the lowest mark or earlier;
    ``order`` is unique within a key. Each row read may be of any time between its chunk's
    marks.

    Returns typed events with ``step`` (see :func:`~changelog.split_key_changes`): one
    snapshot event per row at its chunk's high mark, and each event after the high mark of
    its key's chunk. A row that changes its key leaves the chunk of the old key and enters
    that of the new one, each by its own marks. Chunks without marks give nothing. Events
    whose position is missing can be placed nowhere and are left out.
    """
    position = order[0]
    events = keyed_events(C.select_tables(changes, database, table), keys, chunks)
    held, later = between_marks(events, marks, position)
    tagged = rows.withColumn("_chunk", chunks.number(F.col(chunks.key)))
    snapshot = snapshot_of(caught_up(tagged, held, keys, order), marks, database, table, position)
    return snapshot.unionByName(event_columns(later), allowMissingColumns=True)
