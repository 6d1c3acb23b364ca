"""Jobs that lose or double records are found out."""

import time

import pytest

from siltstream.operators import logs as L
from siltstream.plans import log_split
from siltstream.sources.files import read_landed
from siltstream.streaming.conservation import ConservationListener, RecordsLost, check, difference
from siltstream.streaming.job import JobOptions

from test_logs import _log

SCHEMA = "id long, value string"


def _land(spark, tmp_path, n=40):
    texts = [(i, "junk" if i % 9 == 0 else _log(f"m{i % 5}", "1", displays=[1, 2])) for i in range(n)]
    spark.createDataFrame(texts, SCHEMA).write.parquet(f"{tmp_path}/in")
    return read_landed(spark, f"{tmp_path}/in", SCHEMA, stream=True)


def _route(lose=0, double=False):
    def route(corrected, full_start=False):
        routed = L.route_logs(corrected, full_start)
        if double:
            return routed.unionByName(routed.where(f"id = 1 and topic = '{L.PAGE_TOPIC}'"))
        return routed.where(f"id >= {lose}")

    return route


def test_a_sound_job_passes(spark, tmp_path):
    query = log_split.run_log_split(
        _land(spark, tmp_path), ["id"], f"{tmp_path}/out", JobOptions(f"{tmp_path}/checkpoint", available_now=True)
    )
    counted = [p.observedMetrics for p in query.recentProgress if p.numInputRows]
    assert [(m["records_in"]["records"], m["records_out"]["records"]) for m in counted] == [(40, 40)]
    check(query)


def test_a_route_that_loses_a_row_is_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_split, "route_logs", _route(lose=1))
    with pytest.raises(RecordsLost, match="1 records of 40 lost"):
        log_split.run_log_split(
            _land(spark, tmp_path), ["id"], f"{tmp_path}/out", JobOptions(f"{tmp_path}/checkpoint", available_now=True)
        )


def test_a_running_job_that_loses_rows_is_stopped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_split, "route_logs", _route(lose=3))
    listener = ConservationListener(spark)
    spark.streams.addListener(listener)
    try:
        query = log_split.run_log_split(
            _land(spark, tmp_path), ["id"], f"{tmp_path}/out", JobOptions(f"{tmp_path}/checkpoint", interval_ms=200)
        )
        deadline = time.time() + 90
        while query.isActive and time.time() < deadline:
            time.sleep(0.2)
        assert not query.isActive
        assert [(q, n) for q, _, n in listener.lost] == [(str(query.id), 3)]
    finally:
        spark.streams.removeListener(listener)


def test_the_difference_counts_both_ways():
    assert difference({}) == difference({"records_in": {"records": 2}}) == 0
    assert difference({"records_in": {"records": 2}, "records_out": {"records": 5}}) == -3
