"""Tables in the folder all executors share, and connected components over links."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which the session or its cluster names.

    Only a session on one machine without that setting, as in tests, gets a temporary folder;
    on a cluster other machines would not see it, and ValueError is raised.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all nodes")
        if context.applicationId not in _own_folders:
            _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="shared-")
        root = _own_folders[context.applicationId]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that later steps neither
    repeat its work nor depend on files of an executor that may be lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python task at a time; a longer row goes alone.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(rows: DataFrame) -> DataFrame:
    """The rows, to be sent to Python tasks a few MB at a time: several copies of a batch are
    in memory at once, outside of Spark's own account. The bound is a setting of the session
    and stays; a lower one of its own is kept."""
    conf = rows.sparkSession.conf
    held = conf.get(BATCH_SETTING).rstrip("bB")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return rows


#: Rows and bytes of text up to which a written table may travel to every task.
MOST_SENT_ROWS, MOST_SENT_BYTES = 500_000, 32 << 20


def sent_if_small(table: DataFrame, size: Column) -> DataFrame:
    """A written table, marked for broadcast if its rows and the sum of their ``size`` are
    within bounds, so that what it is joined to need not move; else as it is."""
    rows, held = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(table) if rows <= MOST_SENT_ROWS and held <= MOST_SENT_BYTES else table


def text_hash() -> Column:
    """Tells rows apart that repeat an id with different texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Connected components of the links ``(a, b)``: rows ``(node, component)``, where
    ``component`` is the smallest node that can be reached.

    Large-star and small-star steps (Kiveris et al., 2014) halve the distance to the
    smallest node in each round. Every step is a minimum per node, which is combined before
    the shuffle, and a join on the node, whose skewed partitions adaptive execution splits.
    Each round's links are written to the shared folder. Links with a null end or with two
    equal ends say nothing and are ignored; no links give no rows.
    """
    spark = links.sparkSession
    links = saved(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v and a is not null and b is not null")
        .distinct(),
        "links",
    )
    before = None
    for _ in range(most_rounds):
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        both = links.union(links.select("v", "u"))
        # Written, so that the join's sides are plain shuffles and a hub's links are split.
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        links = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = links.distinct()
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        links = links.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("link")
        )
        links = saved(links.select("link.u", "link.v").where("u <> v").distinct(), "links")
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
