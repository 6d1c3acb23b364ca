"""Writing records to topics: Kafka, files partitioned by topic, console.

All writers take a DataFrame with the text ``value`` and, where each record picks
its own, the column ``topic``. Streaming DataFrames need :class:`JobOptions`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siltstream.streaming.job import JobOptions

# Writes records, on streams with the settings of the job.
Writer = Callable[[DataFrame, JobOptions | None], StreamingQuery | None]

# Fixed value: where records without a topic go.
DEFAULT_TOPIC = "dwd_default_topic"


def to_topic(records: DataFrame, topic: str) -> DataFrame:
    """Send all records to one topic."""
    return records.withColumn("topic", F.lit(topic))


def with_default_topic(records: DataFrame, default: str = DEFAULT_TOPIC) -> DataFrame:
    """Each record goes to its own topic, those without one to ``default``."""
    return records.withColumn("topic", F.coalesce("topic", F.lit(default)))


def with_record_id(records: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Add ``record_id``, the same whenever the same input is written again.

    ``identity`` names the columns that tell output rows apart. Their exact values are
    hashed, whatever the session's time zone; a missing value differs from any other.
    """
    types = {field.name: field.dataType for field in records.schema.fields}
    values = F.array(*[_exact_text(name, types[name]) for name in identity])
    return records.withColumn("record_id", F.md5(F.to_json(values)))


def _exact_text(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(name)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise ValueError(f"{name} has parts: name plain columns to tell records apart")
    return F.col(name).cast("string")


def kafka_rows(records: DataFrame, key: str | None = None) -> DataFrame:
    """The columns a Kafka sink takes; ``record_id`` travels as a header."""
    columns = [F.col("value").cast("string").alias("value"), F.col("topic")]
    if key is not None:
        columns.append(F.col(key).cast("string").alias("key"))
    if "record_id" in records.columns:
        header = F.struct(
            F.lit("record_id").alias("key"), F.col("record_id").cast("binary").alias("value")
        )
        columns.append(F.array(header).alias("headers"))
    return records.select(*columns)


def kafka_write_options(servers: str | Sequence[str], **options: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers if isinstance(servers, str) else ",".join(servers),
        "includeHeaders": "true",
    } | options


def write_kafka(
    records: DataFrame,
    servers: str | Sequence[str],
    job: JobOptions | None = None,
    key: str | None = None,
    **options: str,
) -> StreamingQuery | None:
    """Write to Kafka, at least once; readers drop repeats by ``record_id``."""
    rows = kafka_rows(with_default_topic(records), key)
    settings = kafka_write_options(servers, **options)
    if not records.isStreaming:
        rows.write.format("kafka").options(**settings).save()
        return None
    return _job(job).start(rows.writeStream.format("kafka").options(**settings))


def write_files(
    records: DataFrame,
    path: str,
    job: JobOptions | None = None,
    file_format: str = "parquet",
) -> StreamingQuery | None:
    """Write files below ``path``, one folder per topic; exactly once on streams."""
    rows = with_default_topic(records)
    if not records.isStreaming:
        rows.write.partitionBy("topic").format(file_format).save(path)
        return None
    writer = rows.writeStream.format(file_format).partitionBy("topic").option("path", path)
    return _job(job).start(writer)


def write_to(
    target: str | Writer, records: DataFrame, job: JobOptions | None
) -> StreamingQuery | None:
    """Write files below ``target`` if it is a path, else let it write."""
    return target(records, job) if callable(target) else write_files(records, target, job)


def labelled(records: DataFrame, label: str) -> DataFrame:
    return records.select(F.lit(label).alias("label"), "*")


def show_stream(records: DataFrame, job: JobOptions, label: str | None = None) -> StreamingQuery:
    """Print a stream to the console, each row after ``label``. Small streams only."""
    rows = records if label is None else labelled(records, label)
    return _job(job).start(rows.writeStream.format("console").option("truncate", "false"))


def _job(job: JobOptions | None) -> JobOptions:
    if job is None:
        raise ValueError("a streaming write needs JobOptions")
    return job
