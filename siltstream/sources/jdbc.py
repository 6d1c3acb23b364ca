"""Reading a database table in full, in parallel. Needs the database's JDBC driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_read_options(
    url: str,
    table: str,
    partition_column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
    **options: str,
) -> dict[str, str]:
    """Options of a read split into ranges of ``partition_column``.

    The bounds only decide where the ranges are cut; rows outside them are read by
    the first and the last task. Choose an indexed column that is spread evenly.
    """
    if partitions < 1:
        raise ValueError("partitions must be positive")
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    } | options


def read_table(spark: SparkSession, **options) -> DataFrame:
    """One table; ``options`` go to :func:`jdbc_read_options`.

    Each task reads in its own transaction, so pass the time before and after the
    read to :func:`~siltstream.operators.changelog.snapshot_then_changes`.
    """
    return spark.read.format("jdbc").options(**jdbc_read_options(**options)).load()
