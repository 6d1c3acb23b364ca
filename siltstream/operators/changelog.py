"""Change-event operators: parse envelopes, format them, follow the table they denote.

The stateless ones (parse, format, retract) work on batch and streaming
DataFrames; :mod:`siltstream.streaming.changelog` has the stateful streaming forms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstream.functions import change_images as I
from siltstream.functions import json_values as J

# Topic of the formatted feed, and where rejected events go.
CHANGE_TOPIC = "ods_base_db"
DIRTY_CHANGE_TOPIC = "ods_dirty_db"

# Record fields, in output order.
AFTER_FIELDS = ("data", "db", "tableName", "op", "ts")
FULL_FIELDS = ("data", "beforeDate", "db", "tableName", "type", "ts")

_OWN = ("value", "valid", "before", "after", "db", "table", "op", "ts_ms")


def carried(changes: DataFrame) -> list[str]:
    """Columns of the feed itself, such as an offset, which operators pass on."""
    return [name for name in changes.columns if name not in _OWN]


def parse_changes(
    feed: DataFrame,
    row: T.StructType | str | None = None,
    value: str = "value",
    mode: str = J.STRICT,
) -> DataFrame:
    """Parse envelope text to ``before``, ``after``, ``db``, ``table``, ``op``, ``ts_ms``.

    ``row`` declares the row images' fields; without it they are ``VARIANT`` and
    every field survives. ``valid`` is false, never NULL, if the text is not one
    JSON object, has no ``source``, or has an image that cannot be read: a value that
    does not convert to its declared type, or schema-free a repeated name where the
    session does not allow it. The original text stays in ``value``.
    """
    if row is None:
        schema, image = None, "variant"
    else:
        schema = row if isinstance(row, T.StructType) else T.StructType.fromDDL(row)
        image = f"struct<{','.join(f'`{name}`:string' for name in schema.names)}>"
    members = (
        f"before {image}, after {image}, source struct<db:string,`table`:string>,"
        " op string, ts_ms string"
    )
    keep = [name for name in feed.columns if name not in _OWN and name != value]
    parsed = J.once(feed, [*keep, value], {"_event": J.parse_object(value, members, mode)})
    before, read_before = I.read_image(
        F.col("_event.before"), schema, F.get_json_object(value, "$.before")
    )
    after, read_after = I.read_image(
        F.col("_event.after"), schema, F.get_json_object(value, "$.after")
    )
    return parsed.select(
        *keep,
        F.col(value).alias("value"),
        (F.col("_event.source").isNotNull() & read_before & read_after).alias("valid"),
        before.alias("before"),
        after.alias("after"),
        F.col("_event.source.db").alias("db"),
        F.col("_event.source.table").alias("table"),
        F.col("_event.op").alias("op"),
        J.to_long(F.col("_event.ts_ms")).alias("ts_ms"),
    )


def select_tables(
    changes: DataFrame, database: str | None = None, table: str | None = None
) -> DataFrame:
    """Valid events of one database, or of one table of it."""
    kept = F.col("valid")
    if database is not None:
        kept &= F.col("db") == database
    if table is not None:
        kept &= F.col("table") == table
    return changes.where(kept)


def raw_changes(changes: DataFrame) -> DataFrame:
    """The events as received, unformatted."""
    return changes.select(*carried(changes), "value")


def _image_texts(changes: DataFrame) -> tuple[Column, Column]:
    """JSON texts of the old and the new row. Images of a declared type are written from
    their values, others as the event's own text has them."""
    op = F.col("op")
    own = isinstance(changes.schema["after"].dataType, T.VariantType)
    texts = [
        I.image_json(image, *([F.col("value"), name] if own else []))
        for image, name in (
            (I.before_image(op, F.col("before")), "before"),
            (I.after_image(op, F.col("after")), "after"),
        )
    ]
    return texts[0], texts[1]


def format_after(changes: DataFrame) -> DataFrame:
    """New row and origin of every valid event: ``data, db, tableName, op, ts``.

    ``data`` is the new row as JSON text, ``{}`` for a delete; ``op`` stays the
    code and may be anything.
    """
    _, new = _image_texts(changes)
    return changes.select(
        *carried(changes),
        J.emit_when(
            F.col("valid"),
            {
                "data": new,
                "db": F.col("db"),
                "tableName": F.col("table"),
                "op": F.col("op"),
                "ts": F.col("ts_ms"),
            },
        ),
    )


def format_full(changes: DataFrame) -> DataFrame:
    """Both rows, origin and type: ``data, beforeDate, db, tableName, type, ts``.

    ``beforeDate`` is spelled as consumers of the feed expect it. A missing row is
    ``{}``. Events with an unknown operation code are left to
    :func:`rejected_changes`.
    """
    op = F.col("op")
    old, new = _image_texts(changes)
    return changes.select(
        *carried(changes),
        J.emit_when(
            F.col("valid") & I.is_known_op(op),
            {
                "data": new,
                "beforeDate": old,
                "db": F.col("db"),
                "tableName": F.col("table"),
                "type": I.op_name(op),
                "ts": F.col("ts_ms"),
            },
        ),
    )


def rejected_changes(changes: DataFrame, unknown_ops: bool = True) -> DataFrame:
    """Original text of events the formatters leave out.

    With ``unknown_ops`` the complement of :func:`format_full`, otherwise that of
    :func:`format_after`.
    """
    accepted = F.col("valid")
    if unknown_ops:
        accepted &= I.is_known_op(F.col("op"))
    return changes.where(~accepted).select(*carried(changes), "value")


def to_records(formatted: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fold the fields of formatted events into one JSON text ``value``."""
    others = [name for name in formatted.columns if name not in fields]
    return formatted.select(*others, F.to_json(F.struct(*fields)).alias("value"))


def route_changes(changes: DataFrame) -> DataFrame:
    """Fully formatted records and rejected events in one pass, told apart by ``topic``."""
    op = F.col("op")
    accepted = F.col("valid") & I.is_known_op(op)
    old, new = _image_texts(changes)
    record = F.to_json(
        F.struct(
            new.alias("data"),
            old.alias("beforeDate"),
            F.col("db"),
            F.col("table").alias("tableName"),
            I.op_name(op).alias("type"),
            F.col("ts_ms").alias("ts"),
        )
    )
    return changes.select(
        *carried(changes),
        F.when(accepted, F.lit(CHANGE_TOPIC)).otherwise(F.lit(DIRTY_CHANGE_TOPIC)).alias("topic"),
        F.when(accepted, record).otherwise(F.col("value")).alias("value"),
    )


def retract(changes: DataFrame) -> DataFrame:
    """Typed events as a stream of additions and retractions.

    An insert adds the new row, a delete retracts the old one, an update does both,
    the retraction first. Returns the carried columns, ``added`` and the row's
    fields. Stateless.
    """
    op = F.col("op")
    old = F.when(~op.isin(I.SNAPSHOT, I.CREATE) | op.isNull(), F.col("before"))
    new = I.after_image(op, F.col("after"))
    steps = F.array(
        F.struct(F.lit(False).alias("added"), old.alias("row")),
        F.struct(F.lit(True).alias("added"), new.alias("row")),
    )
    present = F.filter(steps, lambda step: step["row"].isNotNull())
    kept = F.when(F.col("valid") & I.is_known_op(op), present)
    return changes.select(*carried(changes), F.inline(kept)).select(
        *carried(changes), "added", "row.*"
    )


def net_rows(retracted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose additions and retractions do not cancel out, with their count ``net``.

    Over the complete changelog of a table this is its current content.
    """
    sign = F.when(F.col("added"), F.lit(1)).otherwise(F.lit(-1))
    return (
        retracted.groupBy(*columns).agg(F.sum(sign).alias("net")).where(F.col("net") != 0)
    )


def key_columns(keys: Sequence[str]) -> list[Column]:
    """Key fields of an event: from the new row or, for a delete, the old one."""
    return [
        F.coalesce(F.col("after").getField(key), F.col("before").getField(key)).alias(key)
        for key in keys
    ]


def split_key_changes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Valid typed events of known type, each about one key.

    An update whose old row has another key than its new one becomes a delete of the old row
    and a creation of the new one; ``step`` (0, then 1) orders the two. What the old row does
    not say cannot differ: an update without it, or without its key, stays one event.
    """
    before, after = F.col("before"), F.col("after")
    known = changes.where(F.col("valid") & I.is_known_op(F.col("op")))
    moved, named = F.lit(False), F.lit(True)
    for key in keys:
        moved |= ~before.getField(key).eqNullSafe(after.getField(key))
        named &= before.getField(key).isNotNull()
    moves = F.col("op").eqNullSafe(I.UPDATE) & named & after.isNotNull() & moved
    nothing = F.lit(None).cast(changes.schema["after"].dataType)

    def step(number: int, op: Column, old: Column, new: Column) -> Column:
        return F.struct(
            op.alias("op"), old.alias("before"), new.alias("after"), F.lit(number).alias("step")
        )

    steps = F.when(
        moves, F.array(step(0, F.lit(I.DELETE), before, nothing), step(1, F.lit(I.CREATE), nothing, after))
    ).otherwise(F.array(step(0, F.col("op"), before, after)))
    others = [name for name in changes.columns if name not in ("op", "before", "after", "step")]
    return known.select(*others, F.inline(steps))


def latest_images(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the last event, as ``last`` = struct of ``op`` and ``after``.

    ``order`` must be unique within a key. Events are combined before the shuffle,
    so a key with a third of all events costs no more than any other. An update that gives
    a row another key ends the row of the old key. Runs on streams as well, in update or
    complete mode.
    """
    events = split_key_changes(changes, keys).select(
        *key_columns(keys),
        F.struct("op", "after").alias("_event"),
        F.struct(*order).alias("_position"),
    )
    return events.groupBy(*keys).agg(F.max_by("_event", "_position").alias("last"))


def current_state(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table a changelog denotes: last image per key, deleted rows left out."""
    last = latest_images(changes, keys, order).select("last.*")
    return last.where(is_live()).select("after.*")


def is_live() -> Column:
    """True for a key's last event if it leaves a row behind."""
    return ~F.col("op").eqNullSafe(I.DELETE) & F.col("after").isNotNull()


def snapshot_events(rows: DataFrame, database: str, table: str, ts_ms: int | Column) -> DataFrame:
    """Rows of a table read in full, as typed events of type snapshot."""
    ts_ms = ts_ms if isinstance(ts_ms, Column) else F.lit(ts_ms)
    image = F.struct(*rows.columns)
    return rows.select(
        F.lit(None).cast("string").alias("value"),
        F.lit(True).alias("valid"),
        F.lit(None).cast(T.StructType(rows.schema.fields)).alias("before"),
        image.alias("after"),
        F.lit(database).alias("db"),
        F.lit(table).alias("table"),
        F.lit(I.SNAPSHOT).alias("op"),
        ts_ms.cast("bigint").alias("ts_ms"),
    )


def changes_after(changes: DataFrame, started_ms: int) -> DataFrame:
    """Events after a time, and those that cannot be placed, which become invalid: events
    without a readable ``ts_ms``. Events of the very millisecond count as before."""
    placed = changes.withColumn("valid", F.col("valid") & F.col("ts_ms").isNotNull())
    return placed.where(~F.col("valid") | (F.col("ts_ms") > started_ms))


def snapshot_then_changes(
    rows: DataFrame,
    changes: DataFrame,
    database: str,
    table: str,
    keys: Sequence[str],
    order: Sequence[str],
    started_ms: int,
    finished_ms: int | None = None,
) -> DataFrame:
    """A full read of a table followed by the changes after it, each counted once.

    ``changes`` are typed events recorded from ``started_ms`` or earlier. If the
    read saw one consistent point in time, leave out ``finished_ms``: what happened
    up to ``started_ms`` is in the rows already and is dropped from the changes. A
    parallel read sees rows at any time up to ``finished_ms``. Keys that changed
    meanwhile are then taken back to their row at ``started_ms``, the old row of
    their first event after it. Either way the result is the exact changelog from
    ``started_ms`` on. Snapshot events have NULL in the carried columns. Events without a
    readable time cannot be placed and are left out; :func:`changes_after` shows them.

    This is a batch operator. To go on with a stream, write its result for the
    changes recorded so far and start the stream at the time they end.
    """
    events = select_tables(changes, database, table).where(F.col("ts_ms") > started_ms)
    if finished_ms is not None:
        meanwhile = events.where(F.col("ts_ms") <= finished_ms)
        rows = _rewind(rows, meanwhile, keys, order)
    snapshot = snapshot_events(rows, database, table, started_ms)
    if isinstance(changes.schema["after"].dataType, T.VariantType):
        for name in ("before", "after"):
            snapshot = snapshot.withColumn(name, F.to_variant_object(name))
    return snapshot.unionByName(events, allowMissingColumns=True)


def _rewind(
    rows: DataFrame, meanwhile: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The table's rows as they were before the events in ``meanwhile``."""
    first = F.min_by(F.struct("op", "before"), F.struct(*order))
    events = split_key_changes(meanwhile, keys).drop(*keys)
    touched = events.select("*", *key_columns(keys)).groupBy(*keys).agg(first.alias("_first"))
    # One join gives both the rows that stay and those taken back, from one reading of the
    # events.
    both = rows.select(*keys, F.struct(*rows.columns).alias("_row")).join(touched, list(keys), "full_outer")
    existed = ~F.col("_first.op").isin(I.SNAPSHOT, I.CREATE) & F.col("_first.before").isNotNull()
    old = F.struct(
        *[
            F.col("_first.before").getField(f.name).cast(f.dataType).alias(f.name)
            for f in rows.schema.fields
        ]
    )
    row = F.when(F.col("_first").isNull(), F.col("_row")).when(existed, old)
    return both.select(row.alias("_row")).where(F.col("_row").isNotNull()).select("_row.*")


def register_table(
    changes: DataFrame,
    name: str,
    keys: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Make a typed changelog queryable as table ``name`` with Spark SQL.

    With ``keys`` and ``order`` the view is the current content of the table (batch
    only). Without them it is the stream of additions and retractions, with the
    column ``added``.
    """
    if keys:
        view = current_state(changes, keys, order or ())
    else:
        retracted = retract(changes)
        view = retracted.drop(*carried(changes))
    view.createOrReplaceTempView(name)
    return view
