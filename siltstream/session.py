"""Session settings the jobs are designed for. Using them is optional."""

from __future__ import annotations

from pyspark.sql import SparkSession

from siltstream.streaming.job import ROCKSDB_PROVIDER, STATE_PROVIDER

SETTINGS = {
    # Join sides are broadcast, or hashed without sorting the wide side, only after
    # their size was measured at run time; skewed partitions are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Of a repeated member name the last one counts, also inside variants.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # State is written as changes, not as full copies, on every micro-batch.
    STATE_PROVIDER: ROCKSDB_PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
