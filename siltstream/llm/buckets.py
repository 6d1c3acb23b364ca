"""Comparing the members of buckets without ever gathering a large bucket in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.llm.shared import saved

#: Members of a bucket that one cell compares with as many others.
BLOCK = 512
MOST_WEIGHT = 1 << 21


def cells(
    members: DataFrame, keys: list[str], member: str, block: int = BLOCK, weight: Column | None = None
) -> DataFrame:
    """Deals the members of each bucket into cells so that every two of them meet.

    Buckets with a single member are left out. A bucket of up to ``block`` members is one
    cell. A larger one is cut into blocks by a hash of the member, with one cell for every
    two blocks, so no cell holds much more than two blocks however large the bucket is. With
    a ``weight``, such as the size of a member's payload, a block also holds about MOST_WEIGHT
    of it, or one member. Adds the cell's ends ``i`` and ``j`` and the block ``own`` of the row.
    """
    # Written first: a join with an aggregate of its own rows could not split a hot key.
    held = F.lit(0) if weight is None else F.sum(weight)
    sizes = members.groupBy(*keys).agg(F.count("*").alias("n"), held.alias("held")).where("n > 1")
    rows = members.join(saved(sizes, "sizes"), keys)
    blocks = F.least(F.col("n"), F.ceil(F.greatest(F.col("n") / block, F.col("held") / MOST_WEIGHT)))
    rows = rows.withColumn("blocks", blocks.cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(7), member), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return rows.drop("n", "held", "blocks", "other")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that each hold one group of a partition sorted by integer ``keys``."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        change = np.zeros(table.num_rows - 1, bool)
        for key in keys:
            values = table[key].to_numpy()
            change |= values[1:] != values[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for start, end in zip(starts, starts[1:]):
            yield table.slice(start, end - start)
        rest = table.slice(starts[-1])
    if rest is not None:
        yield rest


def linked(
    dealt: DataFrame,
    keys: list[str],
    member: str,
    payload: str,
    links: Callable[[list | pa.ListArray], np.ndarray],
) -> DataFrame:
    """Links ``(a, b)`` that join what hangs together in each cell made by :func:`cells`.

    ``links`` gets the payloads of a cell, numbers as a list and lists as they lie in Arrow,
    and returns a boolean matrix of the linked ones.
    A cell of n members gives less than n links: each member is tied to the first of those
    that it reaches inside the cell.
    """
    order = [*keys, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for group in grouped(batches, order):
            if group.num_rows < 2:
                continue
            names = group[member].to_numpy()
            given = group[payload].combine_chunks()
            given = given if pa.types.is_list(given.type) else given.to_pylist()
            for first, reached in trees(links(given)):
                a += [int(names[first])] * len(reached)
                b += names[reached].tolist()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    columns = dict.fromkeys([*order, member, payload])
    rows = dealt.select(*columns).repartition(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, "a long, b long")


def trees(matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The components with two members or more of a symmetric boolean matrix: the first
    member and the others."""
    left = matrix.any(axis=1)
    while left.any():
        first = int(left.argmax())
        reached = np.zeros(len(matrix), bool)
        reached[first] = True
        edge = reached
        while edge.any():
            new = matrix[edge].any(axis=0) & ~reached
            reached |= new
            edge = new
        left &= ~reached
        reached[first] = False
        if reached.any():
            yield first, np.flatnonzero(reached)
