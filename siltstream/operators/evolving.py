"""Tables whose columns come, go and widen while their feed runs.

A change event describes its rows itself, so no schema is declared: it is merged over the
images, and each image is read with the merged one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstream.functions.evolving_types import from_variant_schema, merged, settled


def image_schema(changes: DataFrame) -> T.StructType:
    """The type that holds all row images of schema-free events, from one partially combined
    aggregate. Fields that were only null have the null type."""
    found = changes.where("valid").agg(
        F.schema_of_variant_agg("before").alias("before"), F.schema_of_variant_agg("after").alias("after")
    )
    row = found.first()
    return merged(from_variant_schema(row.after), from_variant_schema(row.before))


def read_as(image: Column, schema: T.StructType) -> Column:
    """A variant image as a struct of the schema's fields, whatever their names; fields it
    does not have are NULL. Text fields take values of other kinds as JSON."""
    members = F.try_variant_get(image, "$", "map<string,variant>")
    fields = []
    for f in settled(schema):
        member = F.get(F.array(members), F.lit(0)).getItem(F.lit(f.name))
        fields.append(F.try_variant_get(member, "$", f.dataType.simpleString()).alias(f.name))
    return F.when(members.isNotNull(), F.struct(*fields))


def typed_changes(changes: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Schema-free events with typed images, ready for everything that takes typed events.

    Without a ``schema`` it is merged over the images first (batch only). Numbers keep their
    digits up to 38 unless some of a field's values have an exponent; a field of several
    kinds is text. Events without images of any field keep empty ones.
    """
    schema = image_schema(changes) if schema is None else schema
    if not schema.fields:
        raise ValueError("no event has a row image")
    images = {name: read_as(F.col(name), schema) for name in ("before", "after")}
    return changes.select(
        *[images[c].alias(c) if c in images else F.col(c) for c in changes.columns]
    )


def recast(image: Column, old: T.StructType, new: T.StructType) -> Column:
    """A typed image of an older schema in a newer, wider one."""
    names = set(old.names)
    fields = [
        _wide(image.getField(f.name), old[f.name].dataType, f.dataType).alias(f.name)
        if f.name in names
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in new
    ]
    return F.when(image.isNotNull(), F.struct(*fields))


def _wide(value: Column, old: T.DataType, new: T.DataType) -> Column:
    if old == new:
        return value
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return recast(value, old, new)
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return F.transform(value, lambda v: _wide(v, old.elementType, new.elementType))
    if isinstance(new, T.StringType) and isinstance(old, (T.StructType, T.ArrayType)):
        return F.to_json(value)
    return value.cast(new)
