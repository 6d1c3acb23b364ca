"""Column helpers for JSON text whose members are not known in advance.

Everything here is a native expression. Text is checked and parsed in one go by
:func:`parse_object`, which returns the named members as a struct; members whose
shape is open are declared ``VARIANT``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = "strict"
LENIENT = "lenient"

_JSON_SPACE = " \t\n\r"

_READ_OPTIONS = {
    STRICT: {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"},
    LENIENT: {
        "allowSingleQuotes": "true",
        "allowUnquotedFieldNames": "true",
        "allowNonNumericNumbers": "false",
    },
}

_MEMBER_NAME = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# White space outside strings, or a string, which is put back.
_SPACE = f"({_MEMBER_NAME})|[ \\t\\r\\n]+"
# The match is the leftmost one, so a string that is not the name of a null member
# is consumed whole by the last branch and its content is never taken for a member.
_NULL_MEMBER = (
    f",{_MEMBER_NAME}:null(?=[,}}])|{_MEMBER_NAME}:null,?|({_MEMBER_NAME})"
)


#: Brackets in brackets that the patterns of exact members follow.
NESTING = 32
_GAP = "[ \\t\\r\\n]*+"


def _bracketed(depth: int) -> str:
    """Pattern of an object or array of valid JSON. Quantifiers are possessive, which Java
    runs as loops, so that only nesting and never length takes stack."""
    plain = r'[^"\[\]{}]*+'
    inside = _MEMBER_NAME
    pattern = ""
    for _ in range(depth):
        pattern = rf"[\[{{]{plain}(?:(?:{inside}){plain})*+[\]}}]"
        inside = f"{_MEMBER_NAME}|{pattern}"
    return pattern


_VALUE = rf'(?:{_MEMBER_NAME}|{_bracketed(NESTING)}|[^,\[\]{{}}" \t\r\n]++)'
_MEMBER = f"{_MEMBER_NAME}{_GAP}:{_GAP}{_VALUE}{_GAP}"


def once(frame: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """Select ``keep`` and add ``columns``, evaluating each exactly once per row.

    Catalyst pushes a filter on a projected column below the projection and so
    evaluates its expression twice, which for JSON parsing doubles the cost of the
    job. It does not push through a generator, hence the one-element array.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return frame.select(*keep, F.inline(F.array(row)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` names it.

    Spark repeats an expression at every place it is named in the branches of a condition.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def emit_when(condition: Column, columns: dict[str, Column]) -> Column:
    """Generator of one row if ``condition`` holds, else of none."""
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return F.inline(F.when(condition, F.array(row)))


def parse_object(value: Column | str, members: str, mode: str = STRICT) -> Column:
    """The named members of text that is exactly one JSON object, else NULL.

    ``members`` is a DDL field list. ``strict`` accepts the JSON grammar only,
    ``lenient`` also unquoted field names and single-quoted strings. Of a repeated
    name the last one counts.

    Spark's JSON parser stops after the first complete value. The text is therefore
    parsed as the only element of an array, where trailing characters are an error
    unless they close the array (``{"a":1}] xx``); such a text cannot also close an
    object, so the text as the member of an object must be readable as well.
    """
    value = F.col(value) if isinstance(value, str) else value
    options = _READ_OPTIONS[mode]
    wrapped = F.from_json(
        F.concat(F.lit("["), value, F.lit("]")), f"array<struct<{members}>>", options
    )
    alone = F.filter(F.array(wrapped), lambda elements: F.size(elements) == 1)
    member = F.concat(F.lit('{"v":'), value, F.lit("}"))
    if mode == STRICT:
        closed = F.json_object_keys(member).isNotNull()
    else:
        closed = F.size(F.from_json(member, "map<string,string>", options)) == 1
    opens = F.ltrim(value, F.lit(_JSON_SPACE)).startswith("{")
    return F.when(opens & closed, F.get(F.get(alone, F.lit(0)), F.lit(0)))


def is_json_object(value: Column | str, mode: str = STRICT) -> Column:
    """True if the text is exactly one JSON object; never NULL."""
    return parse_object(value, "_ string", mode).isNotNull()


def normal_text(value: Column | str, mode: str = STRICT) -> Column:
    """A valid object as strict one-line JSON without null members.

    Strict text is edited, never rewritten: members keep their order and values every
    character; only white space between them and null members go. Loose text goes through
    a variant: members are sorted by name and numbers of more than 38 digits become
    doubles. NULL if it cannot be read as one, which the session decides for repeated names.
    """
    value = F.col(value) if isinstance(value, str) else value
    if mode == STRICT:
        text = F.trim(value, F.lit(_JSON_SPACE))
        needs_edit = F.contains(text, F.lit("null")) | text.rlike("[\n\r]")
        compact = F.regexp_replace(text, _SPACE, "$1")
        return F.when(needs_edit, drop_null_members(compact)).otherwise(text)
    return to_text(F.from_json(value, "variant", _READ_OPTIONS[mode]))


def is_readable(value: Column | str, mode: str = STRICT) -> Column:
    """True if a valid object can also be read as a variant, as routing does with it.

    A name that occurs twice in one object can be read only where the session sets
    ``spark.sql.variant.allowDuplicateKeys``.
    """
    value = F.col(value) if isinstance(value, str) else value
    if mode == STRICT:
        return F.try_parse_json(value).isNotNull()
    return F.from_json(value, "variant", _READ_OPTIONS[mode]).isNotNull()


def object_at(doc: Column, path: str = "$") -> Column:
    """The members of an object as ``MAP<STRING, VARIANT>``; NULL if it is none."""
    return F.try_variant_get(doc, path, "map<string,variant>")


def put(members: Column, name: str, value: Column) -> Column:
    """A member map with ``name`` set to the variant ``value``."""
    others = F.map_filter(members, lambda other, _: other != F.lit(name))
    return F.map_concat(others, F.create_map(F.lit(name), value))


def exact_member(text: Column, name: str) -> Column:
    """A member's value as it is written in the ``text`` of a valid object, to the character.

    NULL if there is no such member, if its name occurs twice or is spelled with an escape,
    or below more than NESTING brackets: take it from the parsed value then.
    """
    named = f'"{name}"{_GAP}:'
    pattern = (
        f"^{_GAP}\\{{{_GAP}(?:(?!{named}){_MEMBER},{_GAP})*+{named}{_GAP}({_VALUE}){_GAP}"
        f"(?:,{_GAP}(?!{named}){_MEMBER})*+\\}}{_GAP}$"
    )
    return bound(F.regexp_extract(text, pattern, 1), lambda found: F.when(found != "", found))


def exact_elements(text: Column) -> Column:
    """The elements of the ``text`` of a valid array as they are written, with the limit of
    :func:`exact_member`."""
    inner = F.regexp_extract(text, f"(?s)^{_GAP}\\[(.*)\\]{_GAP}$", 1)
    return F.regexp_extract_all(inner, F.lit(f"({_VALUE})"), F.lit(1))


def compact(text: Column) -> Column:
    """Valid JSON text without white space between its members."""
    return bound(
        text,
        lambda t: F.when(t.rlike("[ \t\r\n]"), F.regexp_replace(t, _SPACE, "$1")).otherwise(t),
    )


def to_long(text: Column) -> Column:
    """Number text as BIGINT; a fraction is cut off, anything else is NULL."""
    return text.try_cast("decimal(38,9)").try_cast("bigint")


def drop_null_members(text: Column) -> Column:
    """Compact JSON text without its null members, at any depth.

    Nulls inside arrays stay. The text must have no white space between members.
    """
    return F.regexp_replace(text, _NULL_MEMBER, "$1")


def without_nulls(text: Column) -> Column:
    """:func:`drop_null_members` of text that may have some."""
    return F.when(F.contains(text, F.lit(":null")), drop_null_members(text)).otherwise(text)


def to_text(value: Column) -> Column:
    """JSON text of a variant, map or struct without null members."""
    return bound(F.to_json(value), without_nulls)


def member(name: str, value: Column) -> Column:
    """``"name":value`` for a variant; NULL if it is missing or null."""
    return F.when(
        ~F.is_variant_null(value), F.concat(F.lit(f'"{name}":'), F.to_json(value))
    )


def object_text(*members: Column) -> Column:
    """An object's JSON text from :func:`member` texts, without the missing ones."""
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
