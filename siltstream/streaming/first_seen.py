"""First sighting per key on a stream, with keyed state."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstream.streaming.job import use_rocksdb_state

# The code below runs on executors. It is sent along with the query, so the package
# does not have to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Keys are dealt to so many groups by a hash, and a micro-batch asks for each group once.
# Checkpoints depend on it.
_GROUPS = 1 << 10
# Rows that are packed at a time, and their bytes.
_PACKED_ROWS, _PACKED_BYTES = 1 << 16, 16 << 20
# Rows that cannot be a first sighting are packed in so many parts, dealt to that many groups
# per shuffle partition.
_PARTS = _GROUPS_PER_PARTITION = 16


def exact_order(frame: DataFrame, order: Sequence[str]) -> list[Column]:
    """Columns that order rows in Python just as ``order`` does in Spark.

    Missing values come first, told by a column of their own, so that long integers never
    meet a null and stay exact. Times become microseconds, for Python would see local times.
    """
    kinds = {field.name: field.dataType for field in frame.schema.fields}
    columns = []
    for k, name in enumerate(order):
        value, kind = F.col(name), kinds[name]
        if isinstance(kind, T.TimestampType):
            value, kind = F.unix_micros(value), T.LongType()
        elif isinstance(kind, T.TimestampNTZType):
            epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
            value, kind = F.expr(f"timestampdiff(MICROSECOND, {epoch}, `{name}`)"), T.LongType()
        elif isinstance(kind, T.DateType):
            value, kind = F.unix_date(value), T.IntegerType()
        if isinstance(kind, T.IntegralType):
            value = F.coalesce(value.cast("long"), F.lit(0).cast("long"))
        elif isinstance(kind, T.StringType):
            value = F.coalesce(value, F.lit(""))
        columns += [F.col(name).isNotNull().alias(f"_known{k}"), value.alias(f"_value{k}")]
    return columns


def _nulls_first(values: Sequence[Any]) -> tuple:
    return tuple((v is not None, v) for v in values)


def key_text(frame: DataFrame, key: str) -> Column:
    """A key as text, equal just where the keys are."""
    value, kind = F.col(key), frame.schema[key].dataType
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.when(value.isNotNull(), F.to_json(F.struct(value)))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0)
    return value.cast("string")


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def _earliest(key: pa.Array, position: pa.RecordBatch) -> np.ndarray:
    """Which rows are the earliest of their key."""
    frame = position.to_pandas()
    columns = list(frame.columns)
    frame["_key"] = key.to_pandas()
    ordered = frame.sort_values(columns, kind="stable", na_position="first")
    earliest = ordered["_key"].notna() & ~ordered["_key"].duplicated()
    return earliest.sort_index().to_numpy()


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, as many at a time as are packed together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= _PACKED_ROWS or sum(b.nbytes for b in held) >= _PACKED_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pack(columns: int, names: Sequence[str]) -> Callable:
    """Packs rows, of which the first ``columns`` go on, by their group; rows that an earlier
    one of their key precedes go by themselves, to groups below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _in_chunks(batches):
            first = _earliest(chunk.column("_key"), chunk.select(names))
            order = np.flatnonzero(first)
            bucket = chunk.column("_group").to_numpy(zero_copy_only=False)[order].astype(np.int32)
            order = order[np.argsort(bucket, kind="stable")]
            bucket.sort()
            bounds = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(order)]
            others = np.array_split(np.flatnonzero(~first), _PARTS)
            spread = chunk.column("_spread").to_numpy()
            groups, rows, at = [], [], []
            if len(order):
                sent = chunk.take(pa.array(order))
                told, sent = sent.select(["_key", *names]), sent.select(range(columns))
                for begin, end in zip(bounds, bounds[1:]):
                    groups.append(int(bucket[begin]))
                    rows.append(_packed(sent.slice(begin, end - begin)))
                    at.append(_packed(told.slice(begin, end - begin)))
            for part in others:
                if len(part):
                    groups.append(-1 - int(spread[part[0]]))
                    rows.append(_packed(chunk.select(range(columns)).take(pa.array(part))))
                    at.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.int32()), pa.array(at, pa.binary()), pa.array(rows, pa.binary())],
                ["_group", "_at", "_rows"],
            )

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed rows and ``first_seen``."""
    for batch in batches:
        out = []
        for rows, firsts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = _unpacked(rows)
            first = np.zeros(rows.num_rows, bool)
            first[np.frombuffer(firsts, np.int32)] = True
            names = [*rows.schema.names, "first_seen"]
            out.append(pa.RecordBatch.from_arrays([*rows.columns, pa.array(first)], names))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches(max_chunksize=10_000)


class FirstSeenProcessor(StatefulProcessor):
    """Returns packed rows and which of them are first sightings; the state of a group is one
    flag per key.

    Rows in groups below zero are known not to be first and pass through.
    """

    def __init__(self, order: Sequence[str], ttl_ms: int | None = None):
        self._order = list(order)
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getMapState("seen", "key string", "seen boolean", ttlDurationMs=self._ttl_ms)
        self._result = Row("_rows", "_firsts")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] < 0:
            for row in rows:
                yield self._result(row["_rows"], b"")
            return
        held = []
        earliest: dict[str, tuple] = {}
        for row in rows:
            for k, told in enumerate(_unpacked(row["_at"]).to_pylist()):
                at = self._position(told)
                before = earliest.get(told["_key"])
                if before is None or at < before[0]:
                    earliest[told["_key"]] = (at, len(held), k)
            held.append(row["_rows"])
        firsts: list[list[int]] = [[] for _ in held]
        for name, (_, blob, k) in earliest.items():
            was_seen = self._seen.containsKey((name,))
            if not was_seen:
                firsts[blob].append(k)
            if not was_seen or self._ttl_ms is not None:
                self._seen.updateValue((name,), (True,))
        for blob, found in zip(held, firsts):
            yield self._result(blob, np.array(found, np.int32).tobytes())

    def _position(self, row: Row) -> tuple:
        return _nulls_first([row[name] for name in self._order])

    def close(self) -> None:
        pass


def mark_first_seen_stream(
    keyed: DataFrame, order: Sequence[str], key: str = "mid", ttl_ms: int | None = None
) -> DataFrame:
    """Add ``first_seen`` to a stream: true on the first row of each key.

    Earlier micro-batches come first; inside a micro-batch ``order`` decides. Rows go
    through the stateful operator packed, some thousand at a time, for there Python handles
    rows one by one. Only rows that are the earliest of their key among those packed at a
    time can be first, and only those go to the group of their key, which holds those of one
    micro-batch in memory. All others are spread, so a hot key reaches its group a few rows
    at a time.

    State never expires unless ``ttl_ms`` is given.
    """
    use_rocksdb_state(keyed.sparkSession)
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exact = exact_order(keyed, order)
    names = [name for k in range(len(order)) for name in (f"_known{k}", f"_value{k}")]
    placed = keyed.select("*", *exact, key_text(keyed, key).alias("_key")).select(
        "*",
        F.pmod(F.xxhash64("_key"), F.lit(_GROUPS)).cast("int").alias("_group"),
        F.pmod(F.xxhash64(*order), F.lit(_GROUPS_PER_PARTITION * partitions)).cast("int").alias("_spread"),
    )
    packed = placed.mapInArrow(_pack(len(keyed.columns), names), "_group int, _at binary, _rows binary")
    found = packed.groupBy("_group").transformWithState(
        statefulProcessor=FirstSeenProcessor(names, ttl_ms),
        outputStructType="_rows binary, _firsts binary",
        outputMode="append",
        timeMode="none" if ttl_ms is None else "processingTime",
    )
    fields = [T.StructField(f.name, f.dataType) for f in keyed.schema.fields]
    return found.mapInArrow(_unpack, T.StructType([*fields, T.StructField("first_seen", T.BooleanType())]))
