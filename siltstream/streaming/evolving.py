"""Capturing a table as typed rows while its columns change."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siltstream.functions.evolving_types import merged, settled
from siltstream.operators import changelog as C
from siltstream.operators.evolving import image_schema, recast, typed_changes
from siltstream.streaming.changelog import complete_folders
from siltstream.streaming.job import JobOptions

_REGISTER = "version int, since_batch bigint, schema string"


def start_typed_capture(
    changes: DataFrame, database: str, table: str, options: JobOptions, path: str
) -> StreamingQuery:
    """Write the events of one table with typed images, without a declared schema.

    ``changes`` are schema-free events. Each micro-batch merges the types of its images into
    the last version of the schema; if that makes it wider, a new version is entered in the
    register. Rows are written in the version of their micro-batch, ``events/batch=n`` below
    ``path``, and are never written anew: :func:`read_typed_capture` brings all of them to the
    last version. A micro-batch that is run again replaces what it wrote, its version too.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        events = C.select_tables(batch, database, table)
        register = versions(spark, path, before=batch_id)
        known = register[-1][2] if register else T.StructType([])
        # What was only null so far takes the type of its first value.
        schema = merged(known, image_schema(events))
        if schema != known:
            register.append((len(register) + 1, batch_id, schema))
        if schema.fields:
            typed = typed_changes(events, schema).withColumn("version", F.lit(len(register)))
            typed.drop("value", "valid").write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
        rows = [(v, n, s.json()) for v, n, s in register]
        spark.createDataFrame(rows, _REGISTER).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/register/batch={batch_id}"
        )

    return options.start(changes.writeStream.foreachBatch(write))


def versions(
    spark: SparkSession, path: str, before: int | None = None
) -> list[tuple[int, int, T.StructType]]:
    """The versions of the schema: number, the micro-batch that brought it, and type."""
    batches = [n for n in complete_folders(spark, f"{path}/register", "batch") if before is None or n < before]
    if not batches:
        return []
    rows = spark.read.schema(_REGISTER).parquet(f"{path}/register/batch={batches[-1]}").collect()
    found = [(r.version, r.since_batch, T.StructType.fromJson(json.loads(r.schema))) for r in rows]
    return sorted(found, key=lambda version: version[0])


def read_typed_capture(spark: SparkSession, path: str) -> DataFrame:
    """All events written by :func:`start_typed_capture`, their images in the last version of
    the schema, with the ``version`` they were written in."""
    register = versions(spark, path)
    if not register:
        raise ValueError(f"nothing was captured below {path}")
    kinds = {version: settled(schema) for version, _, schema in register}
    newest = kinds[register[-1][0]]
    since = {version: batch for version, batch, _ in register}
    batches = complete_folders(spark, f"{path}/events", "batch")
    parts = []
    for version, kind in kinds.items():
        mine = [n for n in batches if max((v for v in since if since[v] <= n), default=0) == version]
        if not mine:
            continue
        rows = spark.read.parquet(*[f"{path}/events/batch={n}" for n in mine])
        images = {name: recast(F.col(name), kind, newest) for name in ("before", "after")}
        parts.append(rows.select(*[images[c].alias(c) if c in images else F.col(c) for c in rows.columns]))
    return reduce(DataFrame.unionByName, parts)
