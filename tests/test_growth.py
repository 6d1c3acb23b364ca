"""Work that must not grow with the number of files or with the places that name a value."""

import pytest
from pyspark.sql import functions as F

from siltstream import catalog
from siltstream.functions import json_values as J
from siltstream.operators import changelog as C
from siltstream.sources.once import without_repeats
from siltstream.streaming.job import JobOptions


@pytest.fixture
def readers(monkeypatch):
    """The streams that the queries read, with the options they were given."""
    seen, read = [], catalog.read_landed

    def noted(spark, path, schema, stream=False, max_files=None):
        seen.append((path, max_files))
        return read(spark, path, schema, stream, max_files)

    monkeypatch.setattr(catalog, "read_landed", noted)
    return seen


def test_micro_batches_do_not_follow_the_number_of_files(spark, sf_dir, readers, monkeypatch):
    def written(session, _, out):
        rows = session.range(60).select(F.col("id").cast("string").alias("record_id"), F.lit("t").alias("topic"))
        for _ in range(2):
            rows.withColumn("value", F.lit("v")).repartition(60, "record_id").write.mode("append").parquet(out)

    batches, start = [], JobOptions.start

    def counted(job, writer):
        query = start(job, writer)
        batches.append(len([p for p in query.recentProgress if p.numInputRows]))
        return query

    monkeypatch.setattr(catalog, "_written_twice", written)
    monkeypatch.setattr(JobOptions, "start", counted)
    assert [tuple(r) for r in catalog.sink_repeats_dropped_stream(spark, sf_dir).collect()] == [("t", 60, 60)]
    assert 1 < batches[-1] <= catalog.READINGS + 1


def test_a_part_of_the_feed_lands_in_several_files(spark, sf_dir, readers):
    assert catalog.cdc_chunked_capture_stream(spark, sf_dir).count()
    landed, _ = readers[0]
    assert {path for path, _ in readers} == {landed} and len(readers) == catalog.CHUNKS + 1
    assert len(spark.read.parquet(landed).inputFiles()) > 2 * (catalog.CHUNKS + 1)


def _patterns(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(")


def test_members_are_cut_out_once(spark):
    feed = spark.createDataFrame([("{}",)], "value string")
    changes = C.parse_changes(feed)
    assert _patterns(C.route_changes(changes)) == 2
    assert _patterns(C.format_full(changes)) == 2
    assert _patterns(feed.select(J.compact(J.exact_member(F.col("value"), "a")).alias("text"))) == 1


def test_repeats_are_sorted_once(spark, tmp_path):
    rows = spark.range(9).select(F.col("id").cast("string").alias("record_id"), F.lit("v").alias("value"))
    rows.write.parquet(f"{tmp_path}/in")
    plan = without_repeats(spark.read.parquet(f"{tmp_path}/in"), "1 day")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 1 and plan.count("Exchange") == 1
