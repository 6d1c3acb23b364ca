"""Readers that take each record once, however often it was written."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from siltstream.sinks.topics import kafka_rows, to_topic, with_record_id
from siltstream.sources.files import read_landed
from siltstream.sources.once import record_id_of, without_repeats
from siltstream.streaming.job import JobOptions

SCHEMA = "id int, value string, record_id string, at timestamp"


def _rows(spark, ids, at="2024-01-01 00:00:00"):
    plain = spark.createDataFrame([(i, f"v{i}") for i in ids], "id int, value string")
    return with_record_id(plain, ["id"]).withColumn("at", F.lit(at).cast("timestamp")).select("id", "value", "record_id", "at")


def _read(spark, tmp_path, **options):
    stream = read_landed(spark, f"{tmp_path}/in", SCHEMA, stream=True, max_files=1)
    rows = without_repeats(stream, **options).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    JobOptions(f"{tmp_path}/checkpoint", available_now=True).start(rows)
    return sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_repeats_go_in_batch(spark):
    rows = _rows(spark, [1, 2, 3]).union(_rows(spark, [2, 3, 4], "2024-01-02 00:00:00"))
    nameless = spark.createDataFrame([(9, "v", None, None), (9, "v", None, None)], SCHEMA)
    once = without_repeats(rows.union(nameless), "1 day")
    assert sorted(r.id for r in once.collect()) == [1, 2, 3, 4, 9, 9] and once.columns == rows.columns


def test_repeats_go_on_streams_over_a_restart(spark, tmp_path):
    for ids in ([1, 2, 2, 3], [3, 4], [1, 4, 5]):
        _rows(spark, ids).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = _read(spark, tmp_path, within="1 hour")
    assert out == [1, 2, 3, 4, 5]


def test_no_record_is_late_by_the_readers_clock(spark, tmp_path):
    for day in ("2024-03-01", "2024-01-01", "2023-01-01"):
        _rows(spark, [int(day[5:7]) + int(day[:4])], f"{day} 00:00:00").write.mode("append").parquet(f"{tmp_path}/in")
    assert _read(spark, tmp_path, within="1 minute") == [2024, 2025, 2027]


def test_records_without_an_id_stay_on_streams(spark, tmp_path):
    for _ in range(2):
        spark.createDataFrame([(9, "v", None, None)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    assert _read(spark, tmp_path, within="1 hour") == [9, 9]


def test_ids_are_forgotten_by_the_records_own_time(spark, tmp_path):
    for i, at in [(1, "01 00:00:00"), (1, "01 00:30:00"), (2, "02 00:00:00"), (3, "03 00:00:00"), (1, "04 00:00:00")]:
        _rows(spark, [i], f"2024-01-{at}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # The second is a repeat; days later, when others have passed, the id is free again.
    assert _read(spark, tmp_path, within="1 hour", time="at") == [1, 1, 2, 3]


def test_a_job_that_fails_after_writing_repeats_nothing_for_readers(spark, tmp_path):
    _rows(spark, range(50)).repartition(4).write.parquet(f"{tmp_path}/source")
    failed = []

    def append(rows, batch_id):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("lost after writing")

    def run():
        stream = read_landed(spark, f"{tmp_path}/source", SCHEMA, stream=True)
        JobOptions(f"{tmp_path}/writer", available_now=True).start(stream.writeStream.foreachBatch(append))

    with pytest.raises(StreamingQueryException):
        run()
    run()
    assert spark.read.parquet(f"{tmp_path}/in").count() == 100
    assert _read(spark, tmp_path, within="1 hour") == list(range(50))


def test_the_id_travels_in_kafka_headers(spark):
    rows = kafka_rows(to_topic(_rows(spark, [1]), "t"))
    read = rows.select(record_id_of(F.col("headers")).alias("record_id")).first()
    assert read.record_id == _rows(spark, [1]).first().record_id
    other = spark.sql("SELECT array(named_struct('key', 'a', 'value', CAST('b' AS BINARY))) AS headers")
    assert other.select(record_id_of(F.col("headers")).alias("id")).first().id is None
