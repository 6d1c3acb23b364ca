"""App-log application: raw log text in, dirty, start, page and display topics out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltstream.functions.json_values import STRICT
from siltstream.operators.logs import (
    DIRTY_TOPIC,
    PAGE_TOPIC,
    START_TOPIC,
    correct_is_new,
    parse_logs,
    route_logs,
)
from siltstream.sinks.topics import Writer, with_record_id, write_to
from siltstream.streaming.conservation import check, count_in, count_out
from siltstream.streaming.job import JobOptions

#: Every input gives one record to exactly one of these; displays come on top.
ONE_OF = (DIRTY_TOPIC, START_TOPIC, PAGE_TOPIC)


def split_logs(
    logs: DataFrame,
    order: Sequence[str],
    value: str = "value",
    mode: str = STRICT,
    full_start: bool = False,
    ttl_ms: int | None = None,
) -> DataFrame:
    """The whole chain; see :mod:`siltstream.operators.logs`.

    ``order`` names carried columns that put the records of a device in order and
    identify a record. On streams each micro-batch counts what comes in and what goes out; see
    :mod:`siltstream.streaming.conservation`.
    """
    given = count_in(logs) if logs.isStreaming else logs
    parsed = parse_logs(given, value, mode)
    corrected = correct_is_new(parsed, order, ttl_ms)
    routed = route_logs(corrected, full_start)
    if logs.isStreaming:
        routed = count_out(routed, ONE_OF)
    return with_record_id(routed, [*order, "topic", "position"])


def run_log_split(
    logs: DataFrame,
    order: Sequence[str],
    target: str | Writer,
    job: JobOptions | None = None,
    **options,
) -> StreamingQuery | None:
    """Split logs to ``target``: files below a path, one folder per topic, or whatever a
    writer such as ``partial(write_kafka, servers=...)`` does with the records and the job.

    Forgetting devices by ``ttl_ms`` keeps the job awake, so it cannot be combined
    with ``available_now``: the job would never find itself done. A job that ends is checked
    for lost records; a job that runs on needs a ``ConservationListener`` in its session.
    """
    if options.get("ttl_ms") is not None and job is not None and job.available_now:
        raise ValueError("ttl_ms needs a job that runs on, not available_now")
    query = write_to(target, split_logs(logs, order, **options), job)
    if query is not None and job is not None and job.available_now:
        check(query)
    return query
