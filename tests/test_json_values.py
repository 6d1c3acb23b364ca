import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstream.functions import json_values as J

ONE_OBJECT = ['{"a":1}', ' {"a":1} ', "{}", '\n{"a":1}\t', '{"a":1,"a":2}', '{"a":{"b":[1,{}]}}']
NOT_ONE_OBJECT = [
    '{"a":1', "[1]", "5", "null", "", '{"a":1} xx', '{"a":1}}', '{"a":1}]', '{"a":1},{"b":2}',
    '{"a":1},"w":{}', "{'a':1}", "garbage", '{"a":1} // c', '{"a":01}', '{"a":NaN}', '{"a":1}] xx',
    '{"a":1}] ]', '{"a":1}]}', "{a:1}", '{"a":"x\ty"}', '\xa0{"a":1}', '{"a":1}\x00', '{"a":1,}',
    '{"a":"\\x"}', '{"q":{"a":01}}', '{"q":[1,]}', '{"q":tru}', "[[{}]]", '{"a":1},', ',{"a":1}',
    '"{}"', '{"a":1}{"b":2}', None,
]


def _evaluate(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    result = rows.select("i", column.alias("r")).collect()
    return [r.r for r in sorted(result, key=lambda r: r.i)]


def test_strict_accepts_exactly_one_object(spark):
    assert _evaluate(spark, ONE_OBJECT, J.is_json_object("t")) == [True] * len(ONE_OBJECT)
    assert _evaluate(spark, NOT_ONE_OBJECT, J.is_json_object("t")) == [False] * len(NOT_ONE_OBJECT)


def test_lenient_also_accepts_loose_names_and_quotes(spark):
    loose = ["{'a':1}", "{a:1}", "{a:'x'}"]
    valid = _evaluate(spark, loose + ONE_OBJECT, J.is_json_object("t", J.LENIENT))
    assert all(valid)
    broken = [t for t in NOT_ONE_OBJECT if t not in loose]
    assert not any(_evaluate(spark, broken, J.is_json_object("t", J.LENIENT)))


def test_last_of_repeated_names_counts(spark):
    column = J.parse_object("t", "a string")["a"]
    assert _evaluate(spark, ['{"a":1,"a":2}'], column) == ["2"]


def _python_says(text):
    def no_constant(name):
        raise ValueError(name)

    try:
        return isinstance(json.loads(text, parse_constant=no_constant), dict)
    except ValueError:
        return False


_values = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.text("ab\"\\{}[]:,null ", max_size=6),
    lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text('ab":', max_size=3), v, max_size=3),
    max_leaves=8,
)


@settings(max_examples=4, deadline=None)
@given(
    docs=st.lists(_values, min_size=20, max_size=60),
    tails=st.lists(st.text('{}[]":,1 a', max_size=5), min_size=60, max_size=60),
)
def test_validity_agrees_with_a_reference_parser(spark, docs, tails):
    whole = [json.dumps(d) for d in docs]
    texts = whole + [t + x for t, x in zip(whole, tails)] + [t[:-1] for t in whole] + tails
    expected = [_python_says(t) for t in texts]
    assert _evaluate(spark, texts, J.is_json_object("t")) == expected


def _without_nulls(value):
    if isinstance(value, dict):
        return {k: _without_nulls(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_without_nulls(v) for v in value]
    return value


@settings(max_examples=4, deadline=None)
@given(docs=st.lists(st.dictionaries(st.text('ab":', max_size=3), _values, max_size=4), max_size=60))
def test_null_members_go_at_any_depth(spark, docs):
    texts = [json.dumps(d) for d in docs] + ['{"a":":null","b":null}', '{"a":null,"b":null}']
    normal = _evaluate(spark, texts, J.normal_text("t"))
    for text, result in zip(texts, normal):
        assert json.loads(result) == _without_nulls(json.loads(text))


def test_long_strings_are_no_problem_for_null_removal(spark):
    text = json.dumps({"a": '\\"x' * 200_000, "n": None})
    (result,) = _evaluate(spark, [text], J.normal_text("t"))
    assert json.loads(result) == {"a": '\\"x' * 200_000}


def test_clean_text_is_kept_to_the_character(spark):
    text = '{"b": 1.50, "a":12345678901234567890123456789012345678901234567890.10}'
    assert _evaluate(spark, ["  " + text + "\n"], J.normal_text("t")) == [text]


def test_line_breaks_are_normalised(spark):
    assert _evaluate(spark, ['{"b":\n1}'], J.normal_text("t")) == ['{"b":1}']
    assert _evaluate(spark, ["{'b' : 'x'}"], J.normal_text("t", J.LENIENT)) == ['{"b":"x"}']


def test_to_long(spark):
    texts = ["7", "7.9", "-7.9", "1e3", "x", "", None, "9223372036854775807"]
    assert _evaluate(spark, texts, J.to_long(F.col("t"))) == [
        7, 7, -7, 1000, None, None, None, 9223372036854775807,
    ]


def test_member_and_object_text(spark):
    variant = F.try_parse_json("t")
    texts = ['{"x":[1,null]}', "null", None, '"s"']
    column = J.object_text(J.member("a", variant), F.lit('"b":1'))
    assert _evaluate(spark, texts, column) == [
        '{"a":{"x":[1,null]},"b":1}', '{"b":1}', '{"b":1}', '{"a":"s","b":1}',
    ]


def test_put_replaces_or_adds(spark):
    members = J.object_at(F.try_parse_json("t"))
    column = F.to_json(J.put(members, "k", F.parse_json(F.lit("5"))))
    results = _evaluate(spark, ['{"k":1,"z":2}', '{"z":2}'], column)
    assert [json.loads(r) for r in results] == [{"k": 5, "z": 2}, {"k": 5, "z": 2}]


def _any_value(source, depth):
    kind = source.randrange(9)
    if kind == 0 and depth:
        names = ["a", "page", 'b"c', "é}", "x{"]
        return {source.choice(names): _any_value(source, depth - 1) for _ in range(source.randrange(4))}
    if kind == 1 and depth:
        return [_any_value(source, depth - 1) for _ in range(source.randrange(4))]
    return source.choice([1.5, 1e300, -3, True, None, "s", "]}", '"q\\', '{"page":1}', "é😀\n", 10**22 + 1])


def test_members_and_elements_are_cut_out_as_written(spark):
    source = random.Random(1)
    names = ["a", "page", "z", "pages", '"page"']
    objects = [{k: _any_value(source, 4) for k in source.sample(names, source.randrange(1, 6))} for _ in range(300)]
    texts = [json.dumps(o, ensure_ascii=source.random() < 0.5, indent=source.choice([None, 1])) for o in objects]
    arrays = [[_any_value(source, 3) for _ in range(source.randrange(5))] for _ in range(300)]
    rows = spark.createDataFrame([(i, t, json.dumps(a)) for i, (t, a) in enumerate(zip(texts, arrays))], "i int, o string, a string")
    for r in rows.select("i", J.exact_member(F.col("o"), "page").alias("m"), J.exact_elements(F.col("a")).alias("e")).collect():
        assert (r.m is None) == ("page" not in objects[r.i])
        assert r.m is None or (json.loads(r.m) == objects[r.i]["page"] and r.m in texts[r.i])
        assert [json.loads(t) for t in r.e] == arrays[r.i]


def test_long_members_take_no_stack_and_odd_ones_are_left_to_the_parser(spark):
    long = '{"a":[' + ",".join('{"k":%d.50}' % i for i in range(100_000)) + '],"page":{"x":"' + '\\\\\\"y' * 100_000 + '"}}'
    nested = '{{"a":{}1.0{},"page":1.50}}'
    cases = [
        (long, long[long.index('"page":') + 7 : -1]),
        (nested.format("[" * 31, "]" * 31), "1.50"),
        (nested.format("[" * 40, "]" * 40), None),
        ('{"page":1.0,"page":2.0}', None),
        ('{"p\\u0061ge":1.0}', None),
        (' { "page" : [1.0 , 2] } ', "[1.0 , 2]"),
        ("{}", None),
        (None, None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, o string")
    for r in rows.select("i", J.exact_member(F.col("o"), "page").alias("m")).collect():
        assert r.m == cases[r.i][1]
