"""Supplying the old rows of feeds that carry new rows only.

A feed may say the new row of a change and of the old one no more than its key. Retractions
need the whole old row, which is the new row of the key's event before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstream.functions import change_images as I
from siltstream.operators import changelog as C
from siltstream.operators.chunked import range_of
from siltstream.streaming.old_rows import supply_old_rows_stream

_OUT = ("valid", "before", "after", "db", "table", "op", "ts_ms", "step")


def new_row() -> Column:
    """The row that an event leaves behind, NULL after a delete."""
    return F.when(~F.col("op").eqNullSafe(I.DELETE), F.col("after"))


def with_old_rows(
    changes: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Typed events with the whole old row as ``before``, whatever the feed said of it.

    The old row is the one that the key's event before left behind; ``order`` is unique within
    a key. An update that changes the key, told by the key in its old row, becomes a delete
    and a creation (``step`` 0 and 1). What an event finds decides its type: with an old row
    it is an update or a delete, without one a creation or a snapshot; a delete that finds no
    row, such as a repeated one, says nothing and is left out. So is an event without a key.
    Invalid events and unknown types are left out; see
    :func:`~siltstream.operators.changelog.rejected_changes`.

    Returns the carried columns and ``valid, before, after, db, table, op, ts_ms, step``,
    ready for :func:`~siltstream.operators.changelog.retract`. Works on streams, where it
    keeps the last row of each key as state, the keys dealt to groups by a hash; there earlier micro-batches come first and
    ``order`` decides inside one.

    In batch a key's history is cut into ``ranges`` (by default as many as shuffle partitions)
    by the first column of ``order``, if that is a number or a time. Each range is ordered by
    itself and takes over the last row of the range before, so that a key with a third of all
    events is spread.
    """
    events = C.split_key_changes(changes, keys)
    columns = [*C.carried(changes), *_OUT]
    names = [f"_key{k}" for k in range(len(keys))]
    keyed = events.select(
        *columns, *[column.alias(name) for column, name in zip(C.key_columns(keys), names)]
    )
    keyed = keyed.where(F.greatest(*[F.col(n).isNull().cast("int") for n in names], F.lit(0)) == 0)
    if changes.isStreaming:
        supplied = supply_old_rows_stream(keyed, names, [*order, "step"])
    else:
        supplied = _supplied(keyed, names, [*order, "step"], ranges)
    has_old, deletes = F.col("_old").isNotNull(), F.col("op").eqNullSafe(I.DELETE)
    kind = (
        F.when(deletes, F.lit(I.DELETE))
        .when(has_old, F.lit(I.UPDATE))
        .when(F.col("op") == I.SNAPSHOT, F.lit(I.SNAPSHOT))
        .otherwise(F.lit(I.CREATE))
    )
    found = supplied.where(has_old | (~deletes & F.col("after").isNotNull()))
    filled = {
        "valid": F.lit(True),
        "op": kind,
        "before": F.col("_old"),
        "after": F.when(~deletes, F.col("after")),
    }
    return found.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in columns])


def _supplied(keyed: DataFrame, names: list[str], order: list[str], ranges: int | None) -> DataFrame:
    """``keyed`` with the row before as ``_old``."""
    if ranges is None:
        ranges = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.withColumn("_range", range_of(F.col(order[0]), _bounds(keyed, order[0], ranges)))
    position = F.struct(*order)
    inside = Window.partitionBy(*names, "_range").orderBy(*order)
    rows = ranged.withColumn("_new", F.struct(new_row().alias("row"))).withColumn(
        "_before", F.lag("_new").over(inside)
    )
    # One row per key and range: what it leaves to the next range.
    last = ranged.groupBy(*names, "_range").agg(
        F.max_by(F.struct(new_row().alias("row")), position).alias("_left")
    )
    across = Window.partitionBy(*names).orderBy("_range")
    taken = last.select(*names, "_range", F.lag("_left").over(across).alias("_taken"))
    joined = rows.join(taken, [*names, "_range"], "left")
    old = F.when(F.col("_before").isNotNull(), F.col("_before.row")).otherwise(F.col("_taken.row"))
    return joined.withColumn("_old", old)


def _bounds(keyed: DataFrame, column: str, ranges: int) -> list:
    """Rising bounds that cut a column into about equal ranges."""
    kind = dict(keyed.dtypes)[column]
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    if ranges < 2 or not (numeric or kind in ("timestamp", "timestamp_ntz", "date")):
        return []
    shares = [k / ranges for k in range(1, ranges)]
    found = keyed.agg(F.percentile_approx(column, shares, 1000)).first()[0] or []
    return sorted(set(found))
