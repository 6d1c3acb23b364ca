"""The last row of each key on a stream, with keyed state."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstream.streaming.first_seen import exact_order, _nulls_first
from siltstream.streaming.job import use_rocksdb_state

# The code below runs on executors and is sent along with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DELETE = "d"

#: Keys are dealt to so many groups by a hash, and each group has one state. A micro-batch
#: talks to the state store once per group it touches, not once per key. Checkpoints depend
#: on it.
GROUPS = 1 << 15

# Values of these types are equal and ordered in Python as they are in Spark.
_PLAIN = (T.IntegralType, T.StringType, T.BooleanType, T.DecimalType, T.DateType, T.TimestampNTZType)


def key_value(value: Column, kind: T.DataType) -> Column:
    """A key as a value that Python can look up, equal there just where it is in Spark."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return (value + F.lit(0.0)).cast("string")
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.to_json(F.struct(value))
    return value


class OldRowProcessor(StatefulProcessor):
    """Returns each event with the row its key had before as ``_old``.

    The state of a group is the last row of each of its keys. The events of a group in one
    micro-batch are put in order in memory.
    """

    def __init__(self, sent: Sequence[str], columns: Sequence[str], keys: Sequence[str], order: Sequence[str]):
        self._columns = list(columns)
        self._keys = [sent.index(name) for name in keys]
        self._order = [sent.index(name) for name in order]
        self._op, self._after = sent.index("op"), sent.index("after")

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("rows", T.BinaryType())])
        self._rows = handle.getValueState("rows", schema)
        self._result = Row(*self._columns, "_old")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self._rows.get()
        last = pickle.loads(found[0]) if found else {}
        width = len(self._columns)
        for row in sorted(rows, key=self._position):
            mine = tuple([row[k] for k in self._keys])
            yield self._result(*row[:width], last.get(mine))
            if row[self._op] == DELETE or row[self._after] is None:
                last.pop(mine, None)
            else:
                last[mine] = row[self._after]
        if last:
            self._rows.update((pickle.dumps(last, protocol=5),))
        elif found:
            self._rows.clear()

    def _position(self, row: Row) -> tuple:
        return _nulls_first([row[k] for k in self._order])

    def close(self) -> None:
        pass


def supply_old_rows_stream(keyed: DataFrame, names: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``keyed`` events, without the old row the feed said, with the row before them as
    ``_old``; see :func:`~siltstream.operators.old_rows.with_old_rows`. State lasts as long as
    a row."""
    use_rocksdb_state(keyed.sparkSession)
    kinds = {field.name: field.dataType for field in keyed.schema.fields}
    # Every column that goes through Python costs time per row.
    columns = [name for name in keyed.columns if name not in names and name not in ("before", "valid")]
    placed = keyed.select(
        *columns,
        *[key_value(F.col(name), kinds[name]).alias(name) for name in names],
        *exact_order(keyed, order),
    )
    at: list[str] = []
    for k, name in enumerate(order):
        plain = name in columns and isinstance(kinds[name], _PLAIN)
        at += [name] if plain else [f"_known{k}", f"_value{k}"]
    sent = [*columns, *names, *[name for name in at if name not in columns]]
    group = F.pmod(F.xxhash64(*names), F.lit(GROUPS)).cast("int").alias("_group")
    fields = [T.StructField(name, kinds[name]) for name in columns]
    return placed.select(*sent, group).groupBy("_group").transformWithState(
        statefulProcessor=OldRowProcessor(sent, columns, names, at),
        outputStructType=T.StructType([*fields, T.StructField("_old", kinds["after"])]),
        outputMode="append",
        timeMode="none",
    )
