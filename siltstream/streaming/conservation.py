"""Checking that a job neither loses nor doubles records: what comes in goes out once."""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

IN, OUT = "records_in", "records_out"


class RecordsLost(RuntimeError):
    """A micro-batch gave another number of records than it was given."""


def count_in(records: DataFrame) -> DataFrame:
    """Counts the records of each micro-batch on their way, without a pass of their own."""
    return records.observe(IN, F.count(F.lit(1)).alias("records"))


def count_out(routed: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Counts the records of the routes of which each input takes exactly one."""
    mine = F.col("topic").isin(*topics)
    return routed.observe(OUT, F.count(F.when(mine, F.lit(1))).alias("records"))


def difference(metrics: dict) -> int:
    """Records that are missing (below zero: too many) in the observed metrics of a
    micro-batch."""
    if IN not in metrics or OUT not in metrics:
        return 0
    return metrics[IN]["records"] - metrics[OUT]["records"]


def check(query: StreamingQuery) -> None:
    """Raises RecordsLost if one of the last micro-batches of a query lost or doubled records."""
    for progress in query.recentProgress:
        lost = difference(progress.observedMetrics)
        if lost:
            raise RecordsLost(f"micro-batch {progress.batchId}: {lost} records of {progress.numInputRows} lost")


class ConservationListener(StreamingQueryListener):
    """Stops a query after a micro-batch that lost or doubled records.

    ``lost`` holds the query's id, the micro-batch and the difference. The batch itself has
    been written; what the listener prevents is that the job goes on unnoticed.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.session = spark
        self.lost: list[tuple[str, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        lost = difference(progress.observedMetrics)
        if lost:
            self.lost.append((str(progress.id), progress.batchId, lost))
            query = self.session.streams.get(str(progress.id))
            if query is not None:
                # Stopping waits for the query, which may wait for its listeners.
                threading.Thread(target=query.stop, daemon=True).start()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
