"""Exact largest inner products with a KD-tree per shard (operator 7)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstream.llm.buckets import grouped
from siltstream.llm.shared import saved

#: Rows of a shard, of a leaf, and queries that meet a shard at a time.
SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 8192, 128, 1024

ROW = "part long, block long, kind long, vec_id long, vector array<long>, least long"
FOUND = "query_id long, vec_id long, score long"


class Tree:
    """A KD-tree by median splits of the widest side, with the bounding box of the rows of
    every node."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.below: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        self.order = np.arange(len(ids))
        self.source, self.leaf_rows = rows, leaf_rows
        self.split(0, len(ids))
        self.ids, self.rows = ids[self.order], rows[self.order]
        self.low_box, self.high_box = np.array(self.low), np.array(self.high)

    def split(self, start: int, end: int) -> int:
        node, part = len(self.span), self.source[self.order[start:end]]
        self.low.append(part.min(axis=0))
        self.high.append(part.max(axis=0))
        self.span.append((start, end))
        self.below.append(None)
        side = int((self.high[node] - self.low[node]).argmax()) if part.shape[1] else 0
        # Equal rows have a box without width and need no split, however many they are.
        if end - start > self.leaf_rows and part.shape[1] and self.high[node][side] > self.low[node][side]:
            middle = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(part[:, side], middle)]
            self.below[node] = (self.split(start, start + middle), self.split(start + middle, end))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each query can have in the box of each node."""
        return np.maximum(queries, 0) @ self.high_box.T + np.minimum(queries, 0) @ self.low_box.T

    def best(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """The ``k`` best ``(score, -id)`` among the rows but ``own``, best-first: nodes are
        taken by falling bound until none can reach the k-th score. ``least`` is a score
        that k rows elsewhere reach; only rows that reach it too are of interest."""
        found: list[tuple[int, int]] = []
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            floor = found[0][0] if len(found) == k else least
            if floor is not None and -bound < floor:
                break
            if self.below[node]:
                for child in self.below[node]:
                    if floor is None or bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            start, end = self.span[node]
            scores = self.rows[start:end] @ query
            near = np.flatnonzero(scores >= floor) if floor is not None else np.arange(end - start)
            for score, name in zip(scores[near].tolist(), self.ids[start:end][near].tolist()):
                if name == own:
                    continue
                entry = (int(score), -name)
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
        return found


def matrix(lists: list[list[int]]) -> np.ndarray:
    """Rows as doubles if all products and sums of them are exact, else as long integers."""
    rows = np.array(lists, np.int64).reshape(len(lists), len(lists[0]))
    largest = int(np.abs(rows).max(initial=0))
    return rows.astype(np.float64) if largest * largest * max(1, rows.shape[1]) < 1 << 53 else rows


def search(cells: DataFrame, k: int) -> DataFrame:
    """The best rows for each query of each cell: rows of a shard (kind 0), then queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, ["part", "block"]):
            kind = cell["kind"].to_numpy()
            count = int((kind == 0).sum())
            if not count or count == len(kind):
                continue
            names = cell["vec_id"].to_numpy()
            vectors = matrix(cell["vector"].to_pylist())
            tree, queries = Tree(names[:count], vectors[:count]), vectors[count:]
            bounds = tree.bounds(queries)
            rows = []
            for j, (own, least) in enumerate(zip(names[count:].tolist(), cell["least"].to_pylist()[count:])):
                rows += [(own, -name, score) for score, name in tree.best(queries[j], own, bounds[j], k, least)]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    keys = ["part", "block", "kind"]
    rows = cells.repartition("part", "block").sortWithinPartitions(*keys)
    return rows.select("part", "block", "kind", "vec_id", "vector", "least").mapInArrow(run, FOUND)


def whole(vector: Column) -> Column:
    """Components as floor(256 * x)."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """For each query row the ``k`` other rows with the largest inner product of
    floor(256 * x): ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties go to the
    smaller ``vec_id``.

    Rows are dealt by hash into shards of about ``shard_rows``, each with a KD-tree. Every
    query first searches the shard it lies in itself; the k-th score found there goes along
    to all other shards and prunes them from the start. Queries meet a shard in blocks of
    about ``query_rows``, so a task holds one shard and one block however large the table is.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows
    without ``vec_id``. Of rows with the same ``vec_id`` the smallest vector counts. Vectors
    of different lengths do not meet. Fewer than ``k`` other rows are all returned. Scores are
    exact while they fit a long. An empty table gives no rows; other columns are not read.
    """
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(fit)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("vector"))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("asks", is_query)
    rows = saved(rows, "vectors")
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.count_if("asks").alias("q"))
    sizes = sizes.collect()
    # Shards are numbered through all lengths of vectors; there is one length as a rule.
    first, shards, at = {}, {}, 0
    for row in sorted(sizes):
        first[row["d"]], shards[row["d"]] = at, max(1, math.ceil(row["n"] / shard_rows))
        at += shards[row["d"]]
    if not sizes:
        return rows.select("vec_id").where("false").selectExpr(
            "vec_id as query_id", "0 as rank", "vec_id", "vec_id as score"
        )
    blocks = max(1, math.ceil(sum(row["q"] for row in sizes) / query_rows))

    def of(table: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.size("vector")].cast("long")

    rows = rows.withColumn("part", of(first) + F.pmod(F.xxhash64(F.lit(3), "vec_id"), of(shards)))
    none = F.lit(None).cast("long")
    data = rows.select("part", F.lit(0).cast("long").alias("kind"), "vec_id", "vector", none.alias("least"))
    asked = rows.where("asks").withColumn("block", F.pmod(F.xxhash64(F.lit(4), "vec_id"), F.lit(blocks)))
    one = F.lit(1).cast("long").alias("kind")

    home = data.withColumn("block", F.lit(0).cast("long")).unionByName(
        asked.select("part", F.lit(0).cast("long").alias("block"), one, "vec_id", "vector", none.alias("least"))
    )
    near = saved(search(home, k), "near")
    floors = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floors = floors.select("vec_id", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    others = asked.join(floors, "vec_id", "left").withColumnRenamed("part", "home")
    parts = F.sequence(of(first), of(first) + of(shards) - 1)
    others = others.withColumn("part", F.explode(parts)).where("part <> home")
    everywhere = data.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    everywhere = everywhere.unionByName(others.select("part", "block", one, "vec_id", "vector", "least"))
    found = near.union(search(everywhere, k))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
