"""Change-capture applications: one table or a whole database to formatted records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siltstream.operators.changelog import (
    AFTER_FIELDS,
    changes_after,
    format_after,
    parse_changes,
    raw_changes,
    register_table,
    rejected_changes,
    route_changes,
    select_tables,
    snapshot_events,
    to_records,
)
from siltstream.sinks.topics import Writer, write_to
from siltstream.streaming.job import JobOptions


def table_events(feed: DataFrame, database: str, table: str) -> DataFrame:
    """The unformatted events of one table."""
    return raw_changes(select_tables(parse_changes(feed), database, table))


def table_records(feed: DataFrame, database: str, table: str) -> DataFrame:
    """The events of one table as records with the new row."""
    changes = select_tables(parse_changes(feed), database, table)
    return to_records(format_after(changes), AFTER_FIELDS)


def database_records(feed: DataFrame) -> DataFrame:
    """All events as records with both rows, and the rejected ones, by ``topic``."""
    return route_changes(parse_changes(feed))


def rejected_events(feed: DataFrame, row: T.StructType | str | None = None) -> DataFrame:
    """Events of the feed, of any table, that the jobs on one table leave out: unreadable
    text, no source, an unknown operation, or with ``row`` a value of another type."""
    return rejected_changes(parse_changes(feed, row))


def run_database_capture(
    feed: DataFrame, target: str | Writer, job: JobOptions | None = None
) -> StreamingQuery | None:
    """Capture a whole database to ``target``: files below a path, one folder per topic, or
    a writer that takes the records and the job."""
    return write_to(target, database_records(feed), job)


def run_initial_capture(
    tables: Mapping[str, DataFrame],
    feed: DataFrame,
    database: str,
    started_ms: int,
    target: str | Writer,
    job: JobOptions | None = None,
) -> StreamingQuery | None:
    """Capture a database from its full content on: first the rows of ``tables`` (by name,
    each a consistent read at ``started_ms``), then the changes after that time.

    The rows are written once, in batch, and the feed then as a batch or as a stream. Below a
    path they are in the folders ``snapshot`` and ``changes``. To resume a stream call
    :func:`run_changes_after` alone. Events that say no time cannot be placed before or after
    the read; they come out as rejected, like unreadable ones.
    """
    snapshot, changes = (target, target) if callable(target) else (f"{target}/snapshot", f"{target}/changes")
    parts = [
        route_changes(snapshot_events(rows, database, name, started_ms))
        for name, rows in tables.items()
    ]
    write_to(snapshot, reduce(DataFrame.unionByName, parts), None)
    return run_changes_after(feed, started_ms, changes, job)


def run_changes_after(
    feed: DataFrame, started_ms: int, target: str | Writer, job: JobOptions | None = None
) -> StreamingQuery | None:
    """Capture the changes after ``started_ms``; see :func:`run_initial_capture`."""
    return write_to(target, route_changes(changes_after(parse_changes(feed), started_ms)), job)


def declare_table(
    feed: DataFrame,
    name: str,
    row: T.StructType | str,
    database: str,
    table: str,
    keys: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Declare a typed table over a change feed and make it queryable as ``name``."""
    changes = select_tables(parse_changes(feed, row), database, table)
    return register_table(changes, name, keys, order)
