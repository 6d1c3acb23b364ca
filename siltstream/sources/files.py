"""Reading feeds that were landed as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_lines(
    spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None
) -> DataFrame:
    """One record per line, as ``value``."""
    reader = spark.readStream if stream else spark.read
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format("text").load(path)


def read_landed(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    stream: bool = False,
    max_files: int | None = None,
) -> DataFrame:
    """Parquet files that hold the text and its arrival columns."""
    reader = (spark.readStream if stream else spark.read).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
