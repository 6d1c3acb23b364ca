from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from siltstream import catalog
from siltstream.plans.change_capture import database_records
from siltstream.plans.log_split import split_logs
from siltstream.sinks import topics as K
from siltstream.sources import jdbc, kafka
from siltstream.streaming.job import JobOptions, new_folder, shared_folder


def test_kafka_read_options():
    options = kafka.kafka_read_options(
        ["a:1", "b:2"], topics=["x", "y"], max_per_trigger=9, starting="latest"
    )
    assert options == {
        "kafka.bootstrap.servers": "a:1,b:2",
        "subscribe": "x,y",
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": "9",
    }
    first = kafka.kafka_read_options("a:1", pattern="db.*", starting="earliest")
    assert first["subscribePattern"] == "db.*" and first["startingOffsets"] == "earliest"
    with pytest.raises(ValueError):
        kafka.kafka_read_options("a:1", starting="latest")
    with pytest.raises(ValueError):
        kafka.kafka_read_options("a:1", topics="x", pattern="y", starting="latest")
    with pytest.raises(TypeError):
        kafka.kafka_read_options("a:1", topics="x")


def test_kafka_rows_are_read_as_text(spark):
    columns = "CAST('v' AS BINARY) value, 't' topic, 1 partition, 2L offset, current_timestamp() timestamp"
    rows = kafka.text_records(spark.sql(f"SELECT CAST('k' AS BINARY) key, {columns}"))
    assert dict(rows.dtypes)["value"] == "string"
    assert set(kafka.ARRIVAL) < set(rows.columns)


def test_kafka_rows_go_through_both_applications(spark):
    log = '{"common":{"mid":"m","is_new":"1"}}'
    event = '{"source":{"db":"d","table":"t"},"op":"c","after":{"id":1},"ts_ms":1}'
    records = spark.createDataFrame(
        [(log.encode(), "in", 0, i, datetime(2024, 1, 1)) for i in (7, 8)]
        + [(event.encode(), "in", 1, 7, datetime(2024, 1, 1))],
        "value binary, topic string, partition int, offset long, timestamp timestamp",
    )
    rows = kafka.text_records(records)
    routed = split_logs(rows, kafka.ARRIVAL).collect()
    assert {(r.partition, r.offset): r.topic for r in routed} == {
        (0, 7): "dwd_page_log", (0, 8): "dwd_page_log", (1, 7): "dwd_dirty_log",
    }
    assert {r.offset: '"is_new":"0"' in r.value for r in routed if r.partition == 0} == {
        7: False, 8: True,
    }
    captured = {(r.partition, r.offset): r.topic for r in database_records(rows).collect()}
    assert captured[1, 7] == "ods_base_db" and captured[0, 7] == "ods_dirty_db"
    with pytest.raises(ValueError):
        split_logs(rows.withColumn("topic", F.lit("x")), kafka.ARRIVAL)


def test_jdbc_read_options():
    options = jdbc.jdbc_read_options("jdbc:x", "t", "id", 1, 100, 8, fetchsize="1000")
    assert options["numPartitions"] == "8" and options["partitionColumn"] == "id"
    assert options["lowerBound"] == "1" and options["fetchsize"] == "1000"
    with pytest.raises(ValueError):
        jdbc.jdbc_read_options("jdbc:x", "t", "id", 1, 100, 0)


def test_records_choose_their_topic(spark):
    rows = spark.createDataFrame([("a", "t1"), ("b", None)], "value string, topic string")
    routed = {r.value: r.topic for r in K.with_default_topic(rows).collect()}
    assert routed == {"a": "t1", "b": K.DEFAULT_TOPIC}
    assert {r.topic for r in K.to_topic(rows, "x").collect()} == {"x"}


def test_record_id_is_stable_and_tells_rows_apart(spark):
    rows = spark.range(3).select("id", F.lit(None).cast("int").alias("p"), F.lit("v").alias("value"))
    once = [r.record_id for r in K.with_record_id(rows, ["id", "p"]).orderBy("id").collect()]
    again = [r.record_id for r in K.with_record_id(rows, ["id", "p"]).orderBy("id").collect()]
    assert once == again and len(set(once)) == 3


def test_kafka_rows_for_writing(spark):
    rows = K.with_record_id(
        spark.createDataFrame([("a", "t1", "m")], "value string, topic string, mid string"), ["mid"]
    )
    (row,) = K.kafka_rows(rows, key="mid").collect()
    assert (row.key, row.value, row.topic) == ("m", "a", "t1")
    assert row.headers[0].key == "record_id" and len(row.headers[0].value) == 32
    assert K.kafka_write_options(["a", "b"])["kafka.bootstrap.servers"] == "a,b"


def test_files_are_partitioned_by_topic(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t1"), ("b", None)], "value string, topic string")
    K.write_files(rows, f"{tmp_path}/out", file_format="json")
    assert sorted(p.name for p in (tmp_path / "out").glob("topic=*")) == [
        f"topic={K.DEFAULT_TOPIC}", "topic=t1",
    ]


def test_label(spark):
    assert K.labelled(spark.range(1), "Dirty").first().label == "Dirty"


def test_console_stream(spark, tmp_path):
    spark.range(2).selectExpr("cast(id as string) value").write.text(f"{tmp_path}/in")
    stream = spark.readStream.text(f"{tmp_path}/in")
    query = K.show_stream(stream, JobOptions(f"{tmp_path}/c", available_now=True), "Page")
    assert query.exception() is None and query.recentProgress[-1]["numInputRows"] == 2
    with pytest.raises(ValueError):
        K.write_files(K.to_topic(stream, "t"), f"{tmp_path}/out")


def test_job_options(spark, tmp_path):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        JobOptions("").apply(stream.writeStream)
    with pytest.raises(ValueError):
        JobOptions("c", interval_ms=5, available_now=True).apply(stream.writeStream)
    job = JobOptions(f"{tmp_path}/c", interval_ms=500, name="ticks")
    query = job.start(stream.writeStream.format("noop"))
    try:
        assert query.name == "ticks" and query.isActive
    finally:
        query.stop()


def test_work_folders_are_below_the_shared_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert new_folder(spark, "x") != new_folder(spark, "x")
    assert new_folder(spark, "x").startswith(shared_folder(spark))


def test_only_one_machine_may_go_without_a_shared_folder():
    def session(master):
        context = SimpleNamespace(master=master, applicationId=f"app of {master}", getConf=dict)
        return SimpleNamespace(conf={}, sparkContext=context)

    first, second = (catalog.new_folder(session("local[4]"), "t") for _ in range(2))
    assert first != second and first.rpartition("/")[0] == second.rpartition("/")[0]
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            catalog.new_folder(session(master), "t")
