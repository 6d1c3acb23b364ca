"""App-log operators: parse, correct the first-seen flag, route.

All of them work on batch and streaming DataFrames. The usual chain is
``parse_logs`` -> ``correct_is_new`` -> ``route_logs``. Between them a record is
carried as its text, which is the smallest payload to shuffle and to keep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.functions import json_values as J
from siltstream.streaming.first_seen import mark_first_seen_stream

# Output topics.
DIRTY_TOPIC = "dwd_dirty_log"
START_TOPIC = "dwd_start_log"
DISPLAY_TOPIC = "dwd_display_log"
PAGE_TOPIC = "dwd_page_log"
TOPICS = (DIRTY_TOPIC, START_TOPIC, DISPLAY_TOPIC, PAGE_TOPIC)

_ROUTES = "array<struct<topic:string,position:int,value:string>>"

# Columns the log operators own; all others are carried along.
_OWN = ("value", "mid", "is_new", "corrected")

_FLAG_SET = r'"is_new"\s*:\s*(?:"1"|1)(?=\s*[,}])'


def _carried(frame: DataFrame, value: str = "value") -> list[str]:
    return [name for name in frame.columns if name not in (value, *_OWN)]


def parse_logs(logs: DataFrame, value: str = "value", mode: str = J.STRICT) -> DataFrame:
    """Check log text and pull out the device key.

    Returns the other input columns, ``value``, ``mid`` and ``is_new``. ``mid`` is
    NULL exactly on dirty rows: text that is not one JSON object, an object without
    ``common.mid``, or one that routing could not read (a repeated name, unless the session
    allows it). Dirty rows keep their original text; the text of clean
    ones is normalised by :func:`~siltstream.functions.json_values.normal_text`.
    """
    parsed = J.once(
        logs,
        [*_carried(logs, value), value],
        {"_log": J.parse_object(value, "common struct<mid:string,is_new:string>", mode)},
    )
    mid = F.when(J.is_readable(value, mode), F.col("_log.common.mid"))
    parsed = J.once(
        parsed, [*_carried(logs, value), value], {"mid": mid, "is_new": F.col("_log.common.is_new")}
    )
    clean = F.col("mid").isNotNull()
    return parsed.select(
        *_carried(logs, value),
        F.when(clean, J.normal_text(value, mode)).otherwise(F.col(value)).alias("value"),
        "mid",
        "is_new",
    )


def mark_first_seen(keyed: DataFrame, order: Sequence[str], key: str = "mid") -> DataFrame:
    """Add ``first_seen``: true on the earliest row of each key.

    ``order`` names columns that are unique together within a key. The first
    positions are found with a partially aggregated minimum and matched back on
    key *and* position, so the rows of a key that holds a third of the input are
    spread over all partitions by the join; nothing is windowed per key.
    """
    position = F.struct(*order)
    firsts = (
        keyed.groupBy(F.col(key).alias("_key"))
        .agg(F.min(position).alias("_position"))
        .where(F.col("_key").isNotNull())
    )
    matched = keyed.withColumn("_at", position).join(
        firsts, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_position")), "left"
    )
    return matched.select(*keyed.columns, F.col("_key").isNotNull().alias("first_seen"))


def flag_cleared(value: Column) -> Column:
    """A record's text with ``common.is_new`` rewritten from 1 to ``"0"``.

    If the name occurs once and nothing can be spelled with an escape, that one
    place is edited. Otherwise the record is rebuilt member by member.
    """
    name = '"is_new"'
    occurs_once = F.length(value) - F.length(F.replace(value, F.lit(name), F.lit(""))) == len(name)
    editable = occurs_once & ~F.contains(value, F.lit("\\u")) & value.rlike(_FLAG_SET)
    doc = F.try_parse_json(value)
    common = J.put(J.object_at(doc, "$.common"), "is_new", F.parse_json(F.lit('"0"')))
    rebuilt = F.to_json(J.put(J.object_at(doc), "common", F.to_variant_object(common)))
    return F.when(editable, F.regexp_replace(value, _FLAG_SET, '"is_new":"0"')).otherwise(
        F.coalesce(rebuilt, value)
    )


def correct_is_new(
    parsed: DataFrame, order: Sequence[str], ttl_ms: int | None = None
) -> DataFrame:
    """Rewrite ``is_new`` from ``"1"`` to ``"0"`` for devices already seen.

    Any clean record marks its device as seen, whatever its own flag and whether
    it is a start or a page record. ``value`` and ``is_new`` are updated and
    ``corrected`` (BOOLEAN) is added. In batch ``order`` decides who came first; on
    a stream earlier micro-batches come first and ``order`` decides inside one.
    ``ttl_ms`` (streams only) lets devices be forgotten.
    """
    if parsed.isStreaming:
        marked = mark_first_seen_stream(parsed, order, ttl_ms=ttl_ms)
    else:
        marked = mark_first_seen(parsed, order)
    corrected = (
        F.col("mid").isNotNull() & F.col("is_new").eqNullSafe("1") & ~F.col("first_seen")
    )
    flagged = marked.withColumn("corrected", corrected)
    return flagged.select(
        *_carried(parsed),
        F.when(F.col("corrected"), flag_cleared(F.col("value")))
        .otherwise(F.col("value"))
        .alias("value"),
        "mid",
        F.when(F.col("corrected"), F.lit("0")).otherwise(F.col("is_new")).alias("is_new"),
        "corrected",
    )


def _routed(topic: str, value: Column, position: Column | None = None) -> Column:
    return F.struct(
        F.lit(topic).alias("topic"),
        (F.lit(None).cast("int") if position is None else position).alias("position"),
        value.alias("value"),
    )


def route_logs(
    corrected: DataFrame, full_start: bool = False, topics: Sequence[str] = TOPICS
) -> DataFrame:
    """Split logs into dirty, start, page and display records in one pass.

    Returns the carried columns plus ``topic``, ``position`` (index of a display in
    its record, else NULL) and ``value``. A record with a non-empty ``start`` is a
    start record and only that member is kept (``full_start`` keeps the record);
    any other clean record is a page record and adds one row per display.
    Carried columns, topic and position identify an output row for de-duplication.
    With ``topics`` only the records of these routes are made.
    """
    taken = {"topic", "position"} & set(corrected.columns)
    if taken:
        raise ValueError(f"rename the input columns {sorted(taken)}: routing adds its own")
    members = F.from_json(
        F.when(F.col("mid").isNotNull(), F.col("value")),
        "common variant, page variant, ts string, start variant, displays variant",
    )
    start = F.try_variant_get("_log.start", "$", "string")
    is_start = F.coalesce(F.length("_start") > 0, F.lit(False))
    shown = F.size("_displays") > 0
    staged = (
        corrected.withColumn("_log", members)
        .withColumn("_start", start)
        .withColumn("_displays", F.when(~is_start, _displays()))
        .withColumn("_context", F.when(shown, _display_context()))
        .withColumn("_texts", F.when(shown, _display_texts()))
    )
    nothing = F.array().cast(_ROUTES)

    def route(topic: str, records: Column) -> Column:
        return records if topic in topics else nothing

    displays = route(
        DISPLAY_TOPIC,
        F.transform(
            "_displays",
            lambda display, i: _routed(DISPLAY_TOPIC, _display_text(display, i), i),
        ),
    )
    page = route(PAGE_TOPIC, F.array(_routed(PAGE_TOPIC, F.col("value"))))
    started = F.col("value") if full_start else F.col("_start")
    routes = (
        F.when(
            F.col("mid").isNull(),
            route(DIRTY_TOPIC, F.array(_routed(DIRTY_TOPIC, F.col("value")))),
        )
        .when(is_start, route(START_TOPIC, F.array(_routed(START_TOPIC, started))))
        .when(shown, F.concat(page, displays))
        .otherwise(page)
    )
    return staged.select(*_carried(corrected), F.inline(routes))


def _displays() -> Column:
    """The elements of ``displays``, which may also be an array spelled as a string."""
    array = F.try_variant_get("_log.displays", "$", "array<variant>")
    text = F.try_variant_get("_log.displays", "$", "string")
    spelled = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    return F.coalesce(array, spelled)


def _display_texts() -> Column:
    """The texts of the elements of ``displays`` as they are written; NULL if they cannot be
    told apart there."""
    spelled = F.try_variant_get("_log.displays", "$", "string")
    listed = F.try_variant_get("_log.displays", "$", "array<variant>").isNotNull()
    text = F.when(listed, J.exact_member(F.col("value"), "displays")).otherwise(J.compact(spelled))
    texts = J.exact_elements(text)
    return F.transform(
        F.array(texts), lambda found: F.when(F.size(found) == F.size("_displays"), found)
    )[0]


def _display_context() -> Column:
    """What all displays of a record share: ``common``, ``page`` and ``ts``. Members keep the
    text they have in the record."""
    value, page = F.col("value"), F.col("_log.page")
    common = F.coalesce(J.exact_member(value, "common"), F.to_json("_log.common"))
    text = F.try_variant_get(page, "$", "string")
    spelled = F.when(J.is_json_object(text), J.normal_text(text))
    own = F.when(
        J.object_at(page).isNotNull(), F.coalesce(J.exact_member(value, "page"), J.to_text(page))
    )
    return F.concat_ws(
        ",",
        F.when(~F.is_variant_null("_log.common"), F.concat(F.lit('"common":'), common)),
        F.concat(F.lit('"page":'), F.coalesce(own, spelled)),
        F.concat(F.lit('"ts":'), J.to_long(F.col("_log.ts"))),
    )


def _display_text(display: Column, position: Column) -> Column:
    text = F.coalesce(F.get("_texts", position), F.to_json(display))
    shown = F.when(~F.is_variant_null(display), F.concat(F.lit('"display":'), text))
    return J.object_text(F.col("_context"), shown)


def route_of(corrected: DataFrame, topic: str, full_start: bool = False) -> DataFrame:
    """One route of :func:`route_logs` only."""
    return route_logs(corrected, full_start, [topic]).drop("topic")
