"""How a streaming query is started: checkpoint, trigger, name."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

CHECKPOINT_DIR = "spark.checkpoint.dir"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, which ``transformWithState`` requires."""
    if spark.conf.get(STATE_PROVIDER, "") != ROCKSDB_PROVIDER:
        spark.conf.set(STATE_PROVIDER, ROCKSDB_PROVIDER)


def shared_folder(spark: SparkSession) -> str:
    """The folder all nodes can write to, named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_DIR, None
    )
    if not folder:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all nodes")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_folder`."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class JobOptions:
    """Settings of one streaming job.

    ``checkpoint`` is where progress and state live; it outlives the query, so
    starting the same job again on it resumes. With ``interval_ms`` a micro-batch
    starts that often; ``available_now`` handles what is there and stops; with
    neither, micro-batches follow each other directly.
    """

    checkpoint: str
    interval_ms: int | None = None
    available_now: bool = False
    name: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def apply(self, writer: DataStreamWriter) -> DataStreamWriter:
        if not self.checkpoint:
            raise ValueError("a streaming job needs a checkpoint folder")
        if self.available_now and self.interval_ms is not None:
            raise ValueError("choose either interval_ms or available_now")
        writer = writer.option("checkpointLocation", self.checkpoint).options(**self.options)
        if self.name:
            writer = writer.queryName(self.name)
        if self.available_now:
            writer = writer.trigger(availableNow=True)
        elif self.interval_ms is not None:
            writer = writer.trigger(processingTime=f"{self.interval_ms} milliseconds")
        return writer

    def start(self, writer: DataStreamWriter) -> StreamingQuery:
        """Start the query; with ``available_now`` also wait for its end."""
        query = self.apply(writer).start()
        if self.available_now:
            query.awaitTermination()
        return query
