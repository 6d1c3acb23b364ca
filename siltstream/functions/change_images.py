"""Column helpers for change-event envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstream.functions.json_values import bound, compact, exact_member, to_text, without_nulls

# The operation codes of a change event and their record types.
SNAPSHOT = "r"
CREATE = "c"
UPDATE = "u"
DELETE = "d"
OP_NAMES = {"r": "insert", "c": "insert", "u": "update", "d": "delete"}

EMPTY_IMAGE = "{}"


def is_known_op(op: Column) -> Column:
    """True for the four codes and for a missing one."""
    return op.isNull() | op.isin(*OP_NAMES)


def op_name(op: Column) -> Column:
    """Record type of an operation code: ``""`` if missing, NULL if unknown."""
    name = F.when(op.isNull(), F.lit(""))
    for code, label in OP_NAMES.items():
        name = name.when(op == code, F.lit(label))
    return name


def before_image(op: Column, before: Column) -> Column:
    """The old row; a create has none."""
    return F.when(~op.eqNullSafe(CREATE), before)


def after_image(op: Column, after: Column) -> Column:
    """The new row; a delete has none."""
    return F.when(~op.eqNullSafe(DELETE), after)


def read_image(
    image: Column, schema: T.StructType | None, text: Column
) -> tuple[Column, Column]:
    """A row image, and whether all of it could be read.

    With a schema ``image`` is a struct of the texts of its fields, else a variant, which
    is missing if the ``text`` of the image is an object that could not be read. What is no
    object is no image.
    """
    if schema is None:
        return image, image.isNotNull() | ~F.coalesce(text.startswith("{"), F.lit(False))
    fields = {f.name: (image.getField(f.name), f.dataType) for f in schema.fields}
    typed = {name: _typed(text, kind) for name, (text, kind) in fields.items()}
    complete = F.lit(True)
    for name, (text, _) in fields.items():
        complete &= text.isNull() | typed[name].isNotNull()
    row = F.struct(*[column.alias(name) for name, column in typed.items()])
    return F.when(image.isNotNull(), row), complete


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BinaryType):
        return F.try_to_binary(text, F.lit("base64"))
    if isinstance(kind, T.VariantType):
        return F.try_parse_json(text)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(text, kind)
    return text.try_cast(kind)


def image_json(image: Column, value: Column | None = None, member: str | None = None) -> Column:
    """JSON text of a row image, ``{}`` if there is none; null fields are left out.

    With the event's text as ``value`` and the image's name there as ``member`` the image's
    own text is taken: fields keep their order and values every character. Where it cannot be
    cut out (see :func:`~siltstream.functions.json_values.exact_member`) the parsed image is
    written anew, fields sorted by name.
    """
    text = to_text(image)
    if value is not None:
        own = F.when(image.isNotNull(), compact(exact_member(value, member)))
        text = F.coalesce(bound(own, without_nulls), text)
    return bound(text, lambda t: F.when(t.startswith("{"), t).otherwise(F.lit(EMPTY_IMAGE)))
