"""The current content of a table, kept up to date from a stream of changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstream.operators.changelog import is_live, latest_images
from siltstream.streaming.job import JobOptions, use_rocksdb_state

BatchWriter = Callable[[DataFrame, int], None]


def start_current_state(
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    options: JobOptions,
    path: str | None = None,
    write_batch: BatchWriter | None = None,
    compact_every: int = 20,
) -> StreamingQuery:
    """Keep each key's last event and hand over the keys that changed.

    Every micro-batch yields one row per changed key: the key fields, ``op`` and
    ``after``; deletes come as ``op = 'd'``. The default writer puts them below
    ``path`` for :func:`read_current_state` and folds them into one base every
    ``compact_every`` micro-batches, so that reading costs as much as the table and a few
    batches, however long the history is. A table format with an upsert plugs in
    through ``write_batch(rows, batch_id)``, which may see a batch twice.
    """
    if (path is None) == (write_batch is None):
        raise ValueError("give either path or write_batch")
    use_rocksdb_state(changes.sparkSession)
    latest = latest_images(changes, keys, order).select(*keys, "last.*")
    writer = latest.writeStream.outputMode("update").foreachBatch(
        write_batch or _updates_writer(path, keys, compact_every)
    )
    return options.start(writer)


def _updates_writer(path: str, keys: Sequence[str], compact_every: int) -> BatchWriter:
    def write(rows: DataFrame, batch_id: int) -> None:
        # One folder per micro-batch: a repeated batch replaces its first attempt.
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact_current_state(rows.sparkSession, path, keys)

    return write


def compact_current_state(spark: SparkSession, path: str, keys: Sequence[str]) -> None:
    """Fold the last base and the batches after it into a new base.

    A base counts from when it is complete; a compaction that was cut short leaves a folder
    that no reader takes and the next attempt replaces. Folders it makes superfluous stay
    for readers that have begun with them.
    """
    _, batches = _folders(spark, path)
    if batches:
        rows = _last(spark, path, keys).where(is_live())
        rows.write.mode("overwrite").parquet(f"{path}/base={batches[-1]}")


def clean_current_state(spark: SparkSession, path: str, keep_bases: int = 2) -> list[str]:
    """Delete the folders that the last ``keep_bases`` complete bases make superfluous, and
    return their names.

    Readers that began with one of them fail, so keep as many bases as compactions may pass
    during a reading. Nothing is deleted while there are fewer bases.
    """
    if keep_bases < 1:
        raise ValueError("one base has to stay")
    bases = complete_folders(spark, path, "base")
    if len(bases) < keep_bases:
        return []
    oldest = bases[-keep_bases]
    # What the oldest base that stays holds itself, and bases before it.
    gone = [f"base={n}" for n in bases if n < oldest]
    gone += [f"batch={n}" for n in complete_folders(spark, path, "batch") if n <= oldest]
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [name for name in gone if store.delete(hadoop.Path(root, name), True)]


def read_current_state(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The table's rows from the updates written so far: per key the latest batch counts."""
    return _last(spark, path, keys).where(is_live()).select("after.*")


def complete_folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers n of the folders ``kind=n`` below a path that were written to their end."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    found = []
    for entry in store.listStatus(root):
        name, _, number = entry.getPath().getName().partition("=")
        if name == kind and store.exists(hadoop.Path(entry.getPath(), "_SUCCESS")):
            found.append(int(number))
    return sorted(found)


def _folders(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The last complete base, and the complete batches after it."""
    base = max(complete_folders(spark, path, "base"), default=None)
    batches = complete_folders(spark, path, "batch")
    return base, [n for n in batches if base is None or n > base]


def _last(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Per key the last ``op`` and ``after``."""
    base, batches = _folders(spark, path)
    parts = [spark.read.parquet(f"{path}/batch={n}").withColumn("_batch", F.lit(n)) for n in batches]
    if base is not None:
        parts.append(spark.read.parquet(f"{path}/base={base}").withColumn("_batch", F.lit(base)))
    updates = reduce(DataFrame.unionByName, parts)
    last = F.max_by(F.struct("op", "after"), "_batch").alias("last")
    return updates.groupBy(*keys).agg(last).select(*keys, "last.*")
