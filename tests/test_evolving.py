"""Feeds of tables whose columns come, go and widen."""

import json

import pytest
from pyspark.sql import types as T

from siltstream.functions.evolving_types import from_variant_schema, merged, settled, wider
from siltstream.operators import changelog as C
from siltstream.operators.evolving import image_schema, typed_changes
from siltstream.sources.files import read_landed
from siltstream.streaming.evolving import read_typed_capture, start_typed_capture, versions
from siltstream.streaming.job import JobOptions

from test_changelog import _event, _parse

SCHEMA = "seq int, value string"
LONG, TEXT, DOUBLE = T.LongType(), T.StringType(), T.DoubleType()


@pytest.mark.parametrize(
    "a,b,both",
    [
        (LONG, LONG, LONG),
        (T.NullType(), LONG, LONG),
        (LONG, T.DecimalType(5, 2), T.DecimalType(22, 2)),
        (T.DecimalType(30, 2), T.DecimalType(38, 20), DOUBLE),
        (T.DecimalType(5, 2), T.DecimalType(9, 5), T.DecimalType(9, 5)),
        (LONG, DOUBLE, DOUBLE),
        (LONG, TEXT, TEXT),
        (T.BooleanType(), LONG, TEXT),
        (T.ArrayType(LONG), T.ArrayType(T.NullType()), T.ArrayType(LONG)),
        (T.ArrayType(LONG), LONG, TEXT),
        (T.IntegerType(), LONG, LONG),
    ],
)
def test_wider_types(a, b, both):
    assert wider(a, b) == wider(b, a) == both


def test_structs_merge_by_name(spark):
    a = T.StructType.fromDDL("a bigint, s struct<x:bigint>")
    b = T.StructType.fromDDL("s struct<y:string>, b string")
    assert merged(a, b) == T.StructType.fromDDL("a bigint, s struct<x:bigint,y:string>, b string")
    assert merged(a, T.StructType([])) == a


def test_schemas_of_variants_are_read(spark):
    text = "OBJECT<n: VOID, `OBJECT<q>: x`: BIGINT, o: OBJECT<a: ARRAY<VARIANT>, e: OBJECT<>>>"
    kind = settled(from_variant_schema(text))
    assert kind.names == ["n", "OBJECT<q>: x", "o"] and kind["n"].dataType == TEXT
    assert kind["o"].dataType == T.StructType.fromDDL("a array<string>, e string")
    assert from_variant_schema("VOID") == from_variant_schema(None) == from_variant_schema("BIGINT") == T.StructType([])


IMAGES = [
    {"id": 1, "price": 5, "gone": None},
    {"id": 2, "price": 7.25, "tags": ["a"], "odd name, <x>: `y'": 1},
    {"id": 3, "price": 8, "kind": "s", "in": {"a": 1}},
    {"id": 4, "kind": 9, "in": {"b": 2.5}, "gone": "back"},
    {"id": 5, "kind": {"deep": [1]}, "tags": [2]},
]


def _check(rows):
    found = {r.after.id: r.after.asDict(recursive=True) for r in rows}
    for image in IMAGES:
        row = found[image["id"]]
        for name, value in row.items():
            given = image.get(name)
            if name == "price":
                assert (value is None) == (given is None) and (given is None or float(value) == given)
            elif name == "kind" and isinstance(given, dict):
                assert json.loads(value) == given
            elif name in ("kind", "tags") and given is not None:
                assert value == (str(given) if name == "kind" else [str(v) for v in given])
            elif name == "in" and given is not None:
                assert {k: float(v) for k, v in value.items() if v is not None} == given
            else:
                assert value == given


def test_no_value_is_lost_in_batch(spark):
    changes = _parse(spark, [_event("c", before=None, after=image) for image in IMAGES])
    assert image_schema(changes)["price"].dataType == T.DecimalType(22, 2)
    _check(typed_changes(changes).collect())
    with pytest.raises(ValueError):
        typed_changes(_parse(spark, ["junk"]))


def test_no_value_is_lost_on_streams(spark, tmp_path):
    """Each image arrives by itself; the job is stopped in between, and one arrival is empty."""
    for seq, image in enumerate([*IMAGES, None]):
        texts = [(seq, _event("c", before=None, after=image) if image else "junk")]
        spark.createDataFrame(texts, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        stream = read_landed(spark, f"{tmp_path}/in", SCHEMA, stream=True)
        job = JobOptions(f"{tmp_path}/checkpoint", available_now=True)
        start_typed_capture(C.parse_changes(stream), "shop", "t", job, f"{tmp_path}/out")
    rows = read_typed_capture(spark, f"{tmp_path}/out").collect()
    _check(rows)
    assert {r.after.id: r.version for r in rows} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    register = versions(spark, f"{tmp_path}/out")
    assert [v for v, _, _ in register] == [1, 2, 3, 4]
    # A typed capture is a changelog like any other.
    state = C.current_state(
        read_typed_capture(spark, f"{tmp_path}/out").selectExpr("*", "true AS valid"), ["id"], ["seq"]
    )
    assert sorted(r.id for r in state.collect()) == [1, 2, 3, 4, 5]


def test_nothing_captured(spark, tmp_path):
    with pytest.raises(ValueError):
        read_typed_capture(spark, f"{tmp_path}/none")
