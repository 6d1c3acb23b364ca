"""Reading records that were written more than once, each of them once.

Writers that may repeat a record give it the same ``record_id`` each time, see
:func:`~siltstream.sinks.topics.with_record_id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.streaming.job import use_rocksdb_state

RECORD_ID = "record_id"


def record_id_of(headers: Column) -> Column:
    """The ``record_id`` in the headers of a Kafka record."""
    mine = F.filter(headers, lambda header: header["key"] == RECORD_ID)
    return F.get(mine, F.lit(0))["value"].cast("string")


def without_repeats(records: DataFrame, within: str, time: str | None = None) -> DataFrame:
    """Each record once, told by ``record_id``; records without one all stay.

    On a stream the ids of the last ``within``, such as ``"2 hours"``, are remembered, so
    state is bounded by what is read in that time. It must be longer than a writer takes to
    repeat what it wrote. Without ``time`` the reader's clock counts: no record is ever late,
    and a repeat is found if it is read within that time of the first one. With the name of a
    time column the records' own times count, which suits reading a long history again;
    records that come later than ``within`` behind the latest one are then dropped.

    In batch all of the input counts; repeats are dealt by a hash of their id, so none of it
    depends on how often a record was written. Repeated records are equal but for the columns
    that tell when and where they were written; one of them stays.
    """
    # A record without an id is told apart by itself.
    own = F.coalesce(RECORD_ID, F.concat(F.lit("none-"), F.expr("uuid()")))
    marked = records.withColumn("_id", own)
    if not records.isStreaming:
        # Dealt out first: otherwise whole rows are sorted on both sides of the shuffle.
        return marked.repartition("_id").dropDuplicates(["_id"]).drop("_id")
    use_rocksdb_state(records.sparkSession)
    clock = F.current_timestamp() if time is None else F.col(time)
    kept = marked.withColumn("_clock", clock).withWatermark("_clock", within)
    return kept.dropDuplicatesWithinWatermark(["_id"]).drop("_id", "_clock")
