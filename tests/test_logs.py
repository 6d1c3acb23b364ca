import json
import random

import pytest
from pyspark.sql import functions as F

from siltstream.functions.json_values import LENIENT
from siltstream.operators import logs as L
from siltstream.plans.log_split import run_log_split, split_logs


def _log(mid="m", is_new="1", **members):
    return json.dumps({"common": {"mid": mid, "is_new": is_new}, **members})


def _logs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, value string")


def _route(spark, text, **options):
    rows = split_logs(_logs(spark, [text]), ["id"], **options).collect()
    return sorted((r.topic, r.position, r.value) for r in rows)


def _correct(spark, texts):
    corrected = L.correct_is_new(L.parse_logs(_logs(spark, texts)), ["id"])
    return {r.id: r for r in corrected.collect()}


@pytest.mark.parametrize(
    "text",
    [
        '{"common":{"mid":"a"}', "", "x", "[1]", "null", '{"a":1}', '{"common":{}}',
        '{"common":{"mid":null,"is_new":"1"}}', '{"common":5}', '{"common":null}',
        '{"common":{"mid":"a"}} trailing',
    ],
)
def test_dirty_text_is_kept_as_it_came(spark, text):
    assert _route(spark, text) == [(L.DIRTY_TOPIC, None, text)]


def test_null_text_is_dirty(spark):
    assert _route(spark, None) == [(L.DIRTY_TOPIC, None, None)]


def test_start_record_keeps_only_its_start_member(spark):
    text = _log(start={"entry": "icon"}, displays=[{"item": 1}], ts=1)
    assert _route(spark, text) == [(L.START_TOPIC, None, '{"entry":"icon"}')]


@pytest.mark.parametrize(
    "start, value", [({}, "{}"), ("x", "x"), (5, "5"), ([1, None], "[1,null]"), (":null", ":null")]
)
def test_any_non_empty_start_counts(spark, start, value):
    assert _route(spark, _log(start=start)) == [(L.START_TOPIC, None, value)]


@pytest.mark.parametrize("members", [{}, {"start": ""}, {"start": None}])
def test_empty_start_makes_a_page_record(spark, members):
    ((topic, _, value),) = _route(spark, _log(page={"p": 1}, **members))
    assert topic == L.PAGE_TOPIC
    expected = {"common": {"mid": "m", "is_new": "1"}, "page": {"p": 1}, **members}
    assert json.loads(value) == {k: v for k, v in expected.items() if v is not None}


def test_full_start_keeps_the_record(spark):
    text = _log(start={"entry": "icon"}, ts=1)
    assert _route(spark, text, full_start=True) == [(L.START_TOPIC, None, text)]


@pytest.mark.parametrize("displays", [None, [], "none", {"a": 1}, 5])
def test_no_display_records_without_displays(spark, displays):
    rows = _route(spark, _log(page={"p": 1}, displays=displays))
    assert [topic for topic, *_ in rows] == [L.PAGE_TOPIC]


def test_each_display_becomes_a_record_with_context(spark):
    displays = [{"item": 1, "x": None}, "s", 5, None, [1, None]]
    rows = _route(spark, _log(page={"p": 1.5}, ts="7", displays=displays, other=1))
    shown = [(p, json.loads(v)) for t, p, v in rows if t == L.DISPLAY_TOPIC]
    context = {"common": {"mid": "m", "is_new": "1"}, "page": {"p": 1.5}, "ts": 7}
    elements = [{"item": 1}, "s", 5, None, [1, None]]
    assert shown == [
        (i, context | ({} if e is None else {"display": e})) for i, e in enumerate(elements)
    ]


def test_displays_and_page_may_be_spelled_as_strings(spark):
    rows = _route(spark, _log(page='{"p":1}', displays='[{"item":1}]'))
    (shown,) = [json.loads(v) for t, _, v in rows if t == L.DISPLAY_TOPIC]
    assert shown["page"] == {"p": 1} and shown["display"] == {"item": 1}


def test_display_without_page_and_ts(spark):
    rows = _route(spark, _log(displays=[1], ts="soon", page=3))
    (shown,) = [json.loads(v) for t, _, v in rows if t == L.DISPLAY_TOPIC]
    assert shown == {"common": {"mid": "m", "is_new": "1"}, "display": 1}


def test_page_record_keeps_unknown_members_and_numbers(spark):
    text = '{"zz":{"deep":[1.50,{"q":"\\u00e9"}]},"common":{"mid":"m","is_new":"0","os":"x"}}'
    assert _route(spark, text) == [(L.PAGE_TOPIC, None, text)]


def test_lenient_mode_reads_loose_json_and_writes_strict_json(spark):
    ((topic, _, value),) = _route(spark, "{common:{mid:'m',is_new:'1'},page:{p:1}}", mode=LENIENT)
    assert topic == L.PAGE_TOPIC
    assert json.loads(value) == {"common": {"mid": "m", "is_new": "1"}, "page": {"p": 1}}


def test_first_sighting_keeps_its_flag(spark):
    rows = _correct(spark, [_log(), _log(), _log(mid="other")])
    assert [rows[i].is_new for i in range(3)] == ["1", "0", "1"]
    assert [rows[i].corrected for i in range(3)] == [False, True, False]
    assert json.loads(rows[1].value)["common"]["is_new"] == "0"


def test_any_record_counts_as_a_sighting(spark):
    rows = _correct(spark, [_log(is_new="0"), _log(), _log(mid="s", start={"a": 1}), _log(mid="s")])
    assert [rows[i].is_new for i in range(4)] == ["0", "0", "1", "0"]


def test_dirty_rows_are_no_sighting(spark):
    rows = _correct(spark, ["{", '{"common":{"is_new":"1"}}', _log(), _log()[:-1], _log()])
    assert [rows[i].corrected for i in range(5)] == [False, False, False, False, True]


def test_only_the_flag_value_one_is_rewritten(spark):
    texts = [_log()] + [_log(is_new=v) for v in ("2", "", 1, 1.0, True, None, "1")]
    rows = _correct(spark, texts)
    flags = [json.loads(rows[i].value)["common"].get("is_new") for i in range(8)]
    assert flags == ["1", "2", "", "0", 1.0, True, None, "0"]


@pytest.mark.parametrize(
    "text",
    [
        '{"common":{"mid":"m","is_new":"1"},"x":{"is_new":"1"}}',
        '{"x":["is_new"],"common":{"is_new" : 1 ,"mid":"m"}}',
        '{"common":{"mid":"m","is\\u005fnew":"1"},"x":"\\"is_new\\":\\"1\\""}',
        '{"common":{"mid":"m","is\\u005fnew":"1","z":{"is_new":"1"}}}',
        '{"a":{"common":{"mid":"m","is_new":"1"}},"common":{"mid":"m","is_new":"1"}}',
    ],
)
def test_flag_is_rewritten_in_its_place_only(spark, text):
    rows = _correct(spark, [text, text])
    expected = json.loads(text)
    expected["common"]["is_new"] = "0"
    assert json.loads(rows[1].value) == expected
    assert rows[0].value == text


def _brute_force(logs):
    seen, flags = set(), {}
    for i, mid, flag in sorted(logs):
        flags[i] = "0" if flag == "1" and mid in seen else flag
        seen.add(mid)
    return flags


def test_a_device_with_most_rows_is_corrected_exactly(spark):
    random.seed(3)
    logs = [
        (i, "hot" if random.random() < 0.5 else f"m{random.randrange(300)}", random.choice("01"))
        for i in range(6000)
    ]
    shuffled = random.sample(logs, len(logs))
    frame = spark.createDataFrame(
        [(i, _log(mid, flag)) for i, mid, flag in shuffled], "id long, value string"
    ).repartition(7)
    corrected = L.correct_is_new(L.parse_logs(frame), ["id"])
    assert {r.id: r.is_new for r in corrected.collect()} == _brute_force(logs)


def test_rows_are_spread_by_position_not_by_device(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = L.correct_is_new(L.parse_logs(_logs(spark, [_log()] * 3)), ["id"])
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [line for line in plan.splitlines() if "hashpartitioning(mid" in line]
    assert any("_at" in line for line in wide)
    assert "Window" not in plan and "Python" not in plan and "Cartesian" not in plan
    # Both branches parse the text once: a filter on the result must not repeat it.
    assert plan.count("from_json") == 2


def test_other_columns_are_carried(spark):
    frame = _logs(spark, [_log(displays=[1, 2])]).withColumn("partition", F.lit(4))
    rows = split_logs(frame, ["partition", "id"]).collect()
    assert {(r.id, r.partition) for r in rows} == {(0, 4)}
    assert len({r.record_id for r in rows}) == 3


def test_every_input_row_takes_exactly_one_route(spark, sf_dir):
    from siltstream import fixtures as X

    logs = X.app_logs(spark, sf_dir)
    routed = split_logs(logs, ["ts", "event_id"])
    counts = {r.topic: r["count"] for r in routed.groupBy("topic").count().collect()}
    assert counts == {
        L.DIRTY_TOPIC: 22, L.START_TOPIC: 193, L.PAGE_TOPIC: 785, L.DISPLAY_TOPIC: 1165,
    }
    main = routed.where(F.col("topic") != L.DISPLAY_TOPIC)
    assert main.select("event_id").distinct().count() == main.count() == logs.count()


def test_routes_are_written_to_their_own_folders(spark, tmp_path):
    logs = _logs(spark, [_log(displays=[1]), "x", _log(start="s")])
    run_log_split(logs, ["id"], f"{tmp_path}/out")
    written = spark.read.parquet(f"{tmp_path}/out")
    assert {r.topic for r in written.collect()} == {
        L.DIRTY_TOPIC, L.START_TOPIC, L.PAGE_TOPIC, L.DISPLAY_TOPIC,
    }
