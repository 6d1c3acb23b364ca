"""Reading topics as text.

Needs the ``spark-sql-kafka-0-10`` package on the cluster. Progress is kept in the
job's checkpoint, not in a consumer group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Unique together, and the order of arrival within a partition; pass them as ``order``.
# Records of different partitions have no common order of arrival (their timestamps are
# usually the producers'), so a rule per device needs the topic to be keyed by device.
ARRIVAL = ("source_topic", "partition", "offset")


def kafka_read_options(
    servers: str | Sequence[str],
    topics: str | Sequence[str] | None = None,
    pattern: str | None = None,
    max_per_trigger: int | None = None,
    *,
    starting: str,
    **options: str,
) -> dict[str, str]:
    """Options of a Kafka source for named topics or a name pattern.

    ``starting`` says where a first start begins: ``earliest`` reads what was recorded
    before, ``latest`` leaves it out.
    """
    if (topics is None) == (pattern is None):
        raise ValueError("give either topics or pattern")
    chosen = {
        "kafka.bootstrap.servers": servers if isinstance(servers, str) else ",".join(servers),
        "startingOffsets": starting,
    }
    if topics is not None:
        chosen["subscribe"] = topics if isinstance(topics, str) else ",".join(topics)
    else:
        chosen["subscribePattern"] = pattern
    if max_per_trigger is not None:
        chosen["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return chosen | options


def text_records(records: DataFrame) -> DataFrame:
    """Kafka rows with ``value`` as text and the arrival columns.

    ``topic`` is what a record is written to, so the one it came from is renamed.
    """
    return records.select(
        F.col("value").cast("string").alias("value"),
        "timestamp",
        F.col("topic").alias("source_topic"),
        "partition",
        "offset",
    )


def read_topics(spark: SparkSession, stream: bool = True, **options) -> DataFrame:
    """Topics as text; ``options`` go to :func:`kafka_read_options`."""
    reader = spark.readStream if stream else spark.read
    return text_records(reader.format("kafka").options(**kafka_read_options(**options)).load())
