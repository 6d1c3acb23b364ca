"""Types that grow with the values they must hold."""

from __future__ import annotations

from pyspark.sql import types as T

_WHOLE_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


def _decimal(kind: T.DataType) -> T.DecimalType | None:
    """A number type without exponent as a decimal."""
    if isinstance(kind, T.DecimalType):
        return kind
    digits = _WHOLE_DIGITS.get(type(kind))
    return T.DecimalType(digits, 0) if digits else None


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both.

    Whole numbers and decimals meet in a decimal, with doubles (and beyond 38 digits) in a
    double; structs have the fields of both, by name. What has nothing in common is text.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    x, y = _decimal(a), _decimal(b)
    if x and y:
        if not isinstance(a, T.DecimalType) and not isinstance(b, T.DecimalType):
            return T.LongType()
        scale = max(x.scale, y.scale)
        whole = max(x.precision - x.scale, y.precision - y.scale)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    if (x or isinstance(a, T.DoubleType)) and (y or isinstance(b, T.DoubleType)):
        return T.DoubleType()
    return T.StringType()


def merged(a: T.StructType, b: T.StructType) -> T.StructType:
    """The fields of both, those of ``a`` first; fields of one name take the wider type."""
    kinds = {f.name: f.dataType for f in a}
    for f in b:
        kinds[f.name] = wider(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def settled(kind: T.DataType) -> T.DataType:
    """A type that can be written: what was null so far, or of several kinds, is text."""
    if isinstance(kind, (T.NullType, T.VariantType)):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(settled(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, settled(f.dataType)) for f in kind])
    return kind


def from_variant_schema(text: str | None) -> T.StructType:
    """The type that ``schema_of_variant_agg`` names; no fields if it saw no object."""
    if not text or not text.startswith("OBJECT<"):
        return T.StructType([])
    inside, out, at = False, [], 0
    # Names are quoted where they hold more than letters; only outside of them is OBJECT a type.
    while at < len(text):
        if text[at] == "`":
            inside = not inside
        if not inside and text.startswith("OBJECT<", at):
            out.append("STRUCT<")
            at += len("OBJECT<")
            continue
        out.append(text[at])
        at += 1
    kind = T._parse_datatype_string("".join(out).replace("STRUCT<>", "VARIANT"))
    return kind if isinstance(kind, T.StructType) else T.StructType([])
