"""Every operator as a runnable query over the test tables.

Each query writes its input as text first (:mod:`siltstream.fixtures`) and then runs
the real operators on that text. Streaming queries read the input in two arrivals
from a landed folder and resume from their checkpoint in between.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstream import fixtures as X
from siltstream.functions.json_values import is_json_object
from siltstream.operators import changelog as C
from siltstream.operators import logs as L
from siltstream.operators.chunked import KeyChunks, chunks_then_changes
from siltstream.operators.old_rows import with_old_rows
from siltstream.plans.change_capture import (
    declare_table,
    rejected_events,
    run_database_capture,
    run_initial_capture,
    table_events,
)
from siltstream.plans.log_split import run_log_split, split_logs
from siltstream.sinks.topics import with_record_id, write_files
from siltstream.sources.files import read_landed
from siltstream.sources.once import without_repeats
from siltstream.streaming.changelog import read_current_state, start_current_state
from siltstream.streaming.evolving import read_typed_capture, start_typed_capture
from siltstream.streaming.chunked import read_chunked_capture, start_chunked_capture
from siltstream.streaming import job as streaming_job
from siltstream.streaming.job import JobOptions

Query = Callable[[SparkSession, str], DataFrame]

LOG_ORDER = ["ts", "event_id"]
CHANGE_ORDER = ["ts_ms", "seq"]
ORDER_ROW = "cust bigint, id bigint, price double, status string"
ORDER_COLUMNS = ["cust", "id", "price", "status"]

# Fixed value: when the full read of the snapshot query takes place, between the
# first and the second change of the orders of that day.
SNAPSHOT_MS = 883612800001

# Eight chunks are read, the first after the first time; each reading begins
# 180 days after the one before and takes 60 days of the feed.
CHUNKS = 8
CHUNK_READ_MS = 725846400000
CHUNK_EVERY_MS = 180 * 86400 * 1000
CHUNK_TAKES_MS = 60 * 86400 * 1000

# Fixed value: the declared table of the SQL application.
DECLARED_TABLE = "spu_sale_attr_value"
DECLARED_ROW = (
    "id int, spu_id int, base_sale_attr_id int,"
    " sale_attr_value_name string, sale_attr_name string"
)

# Fixed value: in about how many micro-batches a stream reads what was written twice.
READINGS = 12

_own_folders: dict[str, str] = {}


def new_folder(spark: SparkSession, label: str) -> str:
    """A working folder of a query. A session on one machine that names no shared folder, as
    in a trial run, gets a temporary one."""
    try:
        return streaming_job.new_folder(spark, label)
    except ValueError:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise
        if context.applicationId not in _own_folders:
            _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="siltstream-")
        return f"{_own_folders[context.applicationId]}/{label}-{uuid.uuid4().hex}"


def _parsed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_logs(X.app_logs(spark, sf_dir))


def _corrected_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.correct_is_new(_parsed_logs(spark, sf_dir), LOG_ORDER)


def _routed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_logs(X.app_logs(spark, sf_dir), LOG_ORDER)


def _order_changes(spark: SparkSession, sf_dir: str, typed: bool = True) -> DataFrame:
    feed = X.database_changes(spark, sf_dir)
    changes = C.parse_changes(feed, ORDER_ROW if typed else None)
    return C.select_tables(changes, X.DATABASE, "orders")


def _in_two_arrivals(
    feed: DataFrame, early: Column, start: Callable[[DataFrame, JobOptions], StreamingQuery]
) -> None:
    """Run a stream over rows that land early, then resume it for the others."""
    spark = feed.sparkSession
    folder = new_folder(spark, "arrivals")
    job = JobOptions(checkpoint=f"{folder}/checkpoint", available_now=True)
    for arrival in (early, ~early):
        feed.where(arrival).write.mode("append").parquet(f"{folder}/landed")
        start(read_landed(spark, f"{folder}/landed", feed.schema, stream=True), job)


def _half_time(logs: DataFrame) -> Column:
    middle = logs.agg(((F.min("ts") + F.max("ts")) / 2).cast("bigint")).first()[0]
    return F.col("ts") < middle


def log_json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are one JSON object: logs, event properties, chat messages."""
    logs = X.app_logs(spark, sf_dir).select(
        F.lit("log").alias("kind"),
        F.col("event_id").alias("id"),
        F.lit(0).cast("bigint").alias("part"),
        F.col("value").alias("text"),
    )
    props = X.table(spark, sf_dir, "events").select(
        F.lit("props"), "event_id", F.lit(0).cast("bigint"), "props"
    )
    chats = X.table(spark, sf_dir, "conversations").select(
        F.lit("chat"), "conv_id", "turn", "text"
    )
    texts = logs.union(props).union(chats)
    return texts.select("kind", "id", "part", is_json_object("text").alias("valid"))


def log_dirty_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that is no log record, as it came."""
    return _parsed_logs(spark, sf_dir).where(F.col("mid").isNull()).select("event_id", "value")


def _is_new_columns(corrected: DataFrame) -> DataFrame:
    return corrected.where(F.col("mid").isNotNull()).select(
        "event_id",
        "mid",
        "is_new",
        F.get_json_object("value", "$.common.is_new").alias("text_is_new"),
        "corrected",
    )


def log_is_new_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _is_new_columns(_corrected_logs(spark, sf_dir))


def log_is_new_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = X.app_logs(spark, sf_dir)
    out = new_folder(spark, "is-new")

    def start(stream: DataFrame, job: JobOptions) -> StreamingQuery:
        corrected = L.correct_is_new(L.parse_logs(stream), LOG_ORDER)
        rows = _is_new_columns(corrected)
        return job.start(rows.writeStream.format("parquet").option("path", out))

    _in_two_arrivals(logs, _half_time(logs), start)
    return spark.read.parquet(out)


def _route(spark: SparkSession, sf_dir: str, topic: str) -> DataFrame:
    return L.route_of(_corrected_logs(spark, sf_dir), topic)


def log_start_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route(spark, sf_dir, L.START_TOPIC).select("event_id", "value")


def log_page_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route(spark, sf_dir, L.PAGE_TOPIC).select("event_id", "value")


def log_page_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records whose text must be edited and otherwise kept to the character."""
    parsed = L.parse_logs(X.odd_logs(spark, sf_dir))
    routed = L.route_of(L.correct_is_new(parsed, ["event_id"]), L.PAGE_TOPIC)
    return routed.select("event_id", "value")


def log_display_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route(spark, sf_dir, L.DISPLAY_TOPIC).select("event_id", "position", "value")


def log_display_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display records of objects whose numbers no type holds, to the character."""
    parsed = L.parse_logs(X.odd_displays(spark, sf_dir))
    routed = L.route_of(L.correct_is_new(parsed, ["event_id"]), L.DISPLAY_TOPIC)
    return routed.select("event_id", "position", "value")


def _topic_totals(routed: DataFrame) -> DataFrame:
    return routed.groupBy("topic").agg(
        F.count("*").alias("records"), F.sum(F.length("value")).alias("chars")
    )


def log_topic_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topic_totals(_routed_logs(spark, sf_dir))


def log_topic_fanout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = X.app_logs(spark, sf_dir)
    out = new_folder(spark, "topics")
    _in_two_arrivals(
        logs, _half_time(logs), lambda stream, job: run_log_split(stream, LOG_ORDER, out, job)
    )
    return _topic_totals(spark.read.parquet(out))


def cdc_raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = X.database_changes(spark, sf_dir)
    return table_events(feed, X.DATABASE, "orders")


def cdc_format_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.format_after(_order_changes(spark, sf_dir, typed=False))


def cdc_format_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.format_full(C.parse_changes(X.database_changes(spark, sf_dir)))


def cdc_format_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records of such objects, to the character."""
    return C.format_full(C.parse_changes(X.odd_changes(spark, sf_dir)))


def cdc_capture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database capture application: formatted records, per topic and text."""
    out = new_folder(spark, "capture")
    _in_two_arrivals(
        X.database_changes(spark, sf_dir),
        F.col("seq") == 1,
        lambda stream, job: run_database_capture(stream, out, job),
    )
    return spark.read.parquet(out).select("topic", "seq", "value")


def cdc_snapshot_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read in full at one time, then the changes recorded around it."""
    changes = _order_changes(spark, sf_dir)
    at_start = changes.where(F.col("ts_ms") <= SNAPSHOT_MS)
    rows = C.current_state(at_start, ["id"], CHANGE_ORDER)
    events = C.snapshot_then_changes(
        rows, changes, X.DATABASE, "orders", ["id"], CHANGE_ORDER, SNAPSHOT_MS
    )
    return _event_columns(events)


def cdc_snapshot_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a full read that took long: it shows rows of a later time."""
    changes = _order_changes(spark, sf_dir)
    finished = SNAPSHOT_MS + 30 * 86400 * 1000
    late = changes.where(F.col("ts_ms") <= finished)
    rows = C.current_state(late, ["id"], CHANGE_ORDER)
    events = C.snapshot_then_changes(
        rows, changes, X.DATABASE, "orders", ["id"], CHANGE_ORDER, SNAPSHOT_MS, finished
    )
    return _event_columns(events)


def _event_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.coalesce("after.id", "before.id").alias("id"),
        "op",
        "ts_ms",
        F.col("before.price").alias("old_price"),
        F.col("after.price").alias("new_price"),
        F.col("after.status").alias("status"),
    )


def cdc_select_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared five-column table, queried with SQL."""
    feed = X.attribute_changes(spark, sf_dir)
    declare_table(
        feed, DECLARED_TABLE, DECLARED_ROW, X.DATABASE, DECLARED_TABLE, ["id"], CHANGE_ORDER
    )
    return spark.sql(f"SELECT * FROM {DECLARED_TABLE}")


def cdc_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.retract(_order_changes(spark, sf_dir))


def cdc_retract_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "retract")

    def start(stream: DataFrame, job: JobOptions) -> StreamingQuery:
        changes = C.select_tables(C.parse_changes(stream, ORDER_ROW), X.DATABASE, "orders")
        writer = C.retract(changes).writeStream.format("parquet").option("path", out)
        return job.start(writer)

    _in_two_arrivals(X.database_changes(spark, sf_dir), F.col("seq") == 1, start)
    return spark.read.parquet(out)


def cdc_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.current_state(_order_changes(spark, sf_dir), ["id"], CHANGE_ORDER)


def cdc_current_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "current")

    def start(stream: DataFrame, job: JobOptions) -> StreamingQuery:
        changes = C.select_tables(C.parse_changes(stream, ORDER_ROW), X.DATABASE, "orders")
        return start_current_state(changes, ["id"], CHANGE_ORDER, job, out)

    _in_two_arrivals(X.database_changes(spark, sf_dir), F.col("seq") == 1, start)
    return read_current_state(spark, out, ["id"])


def cdc_net_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.net_rows(C.retract(_order_changes(spark, sf_dir)), ORDER_COLUMNS)


# Declared narrower than some of the values that the faulty feed holds.
FAULTY_ROW = "id int, price double"


def cdc_rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the jobs on a typed table leave out, as it came."""
    return rejected_events(X.faulty_changes(spark, sf_dir), FAULTY_ROW)


def cdc_current_state_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that the other events of the same feed denote."""
    changes = C.parse_changes(X.faulty_changes(spark, sf_dir), FAULTY_ROW)
    return C.current_state(changes, ["id"], ["ts_ms", "order_id"])


def cdc_unplaced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per topic of the feed after a time; events without time are rejected."""
    changes = C.parse_changes(X.faulty_changes(spark, sf_dir))
    routed = C.route_changes(C.changes_after(changes, 100))
    return routed.groupBy("topic").agg(F.count("*").alias("records"))


def cdc_initial_capture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables read in full at one time, then the stream of the changes after it."""
    out = new_folder(spark, "initial")
    changes = _order_changes(spark, sf_dir)
    orders = C.current_state(changes.where(F.col("ts_ms") <= SNAPSHOT_MS), ["id"], CHANGE_ORDER)
    customers = X.table(spark, sf_dir, "customer").selectExpr(
        "c_acctbal AS balance", "c_custkey AS id", "c_name AS name"
    )
    feed = X.database_changes(spark, sf_dir)
    landed = new_folder(spark, "landed")
    feed.write.parquet(landed)
    run_initial_capture(
        {"orders": orders.select(*ORDER_COLUMNS), "customer": customers},
        read_landed(spark, landed, feed.schema, stream=True),
        X.DATABASE,
        SNAPSHOT_MS,
        out,
        JobOptions(checkpoint=f"{landed}-checkpoint", available_now=True),
    )
    read = [spark.read.parquet(f"{out}/{part}") for part in ("snapshot", "changes")]
    return read[0].select("topic", "value").union(read[1].select("topic", "value"))


def sink_default_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent to the topic of their type, sign-ups without one; read back by topic."""
    out = new_folder(spark, "default-topic")
    events = X.table(spark, sf_dir, "events")
    topic = F.when(F.col("event_type") != "signup", F.col("event_type"))
    records = events.select("event_id", "ts", topic.alias("topic"), F.col("props").alias("value"))
    write_files(with_record_id(records, ["ts", "event_id"]), out)
    return spark.read.parquet(out).groupBy("topic").agg(
        F.count("*").alias("records"), F.countDistinct("record_id").alias("ids")
    )


def _rekeyed(spark: SparkSession, sf_dir: str, old_rows: bool = True) -> DataFrame:
    return C.parse_changes(X.rekeyed_changes(spark, sf_dir, old_rows), ORDER_ROW)


def cdc_current_rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of a feed in which rows get other keys."""
    return C.current_state(_rekeyed(spark, sf_dir), ["id"], CHANGE_ORDER)


def cdc_current_rekeyed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "rekeyed")

    def start(stream: DataFrame, job: JobOptions) -> StreamingQuery:
        return start_current_state(C.parse_changes(stream, ORDER_ROW), ["id"], CHANGE_ORDER, job, out)

    _in_two_arrivals(X.rekeyed_changes(spark, sf_dir), F.col("seq") < 3, start)
    return read_current_state(spark, out, ["id"])


def cdc_net_rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.net_rows(C.retract(_rekeyed(spark, sf_dir)), ORDER_COLUMNS)


def cdc_retract_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions and retractions of a feed that does not say the old rows."""
    changes = with_old_rows(_rekeyed(spark, sf_dir, False), ["id"], CHANGE_ORDER)
    return C.retract(changes)


def cdc_retract_new_rows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "new-rows")

    def start(stream: DataFrame, job: JobOptions) -> StreamingQuery:
        changes = with_old_rows(C.parse_changes(stream, ORDER_ROW), ["id"], CHANGE_ORDER)
        return job.start(C.retract(changes).writeStream.format("parquet").option("path", out))

    _in_two_arrivals(X.rekeyed_changes(spark, sf_dir, False), F.col("seq") < 3, start)
    return spark.read.parquet(out)


def cdc_net_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What they add up to: the table."""
    return C.net_rows(cdc_retract_new_rows(spark, sf_dir), ORDER_COLUMNS)


def cdc_evolving_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders captured without a declared schema, while a column comes and one widens."""
    out = new_folder(spark, "evolving")

    def start(stream: DataFrame, job: JobOptions) -> StreamingQuery:
        return start_typed_capture(C.parse_changes(stream), X.DATABASE, "orders", job, out)

    _in_two_arrivals(X.evolving_changes(spark, sf_dir), F.col("arrival") == 1, start)
    return read_typed_capture(spark, out).select(
        "after.id", F.col("after.price").cast("decimal(17,2)").cast("string").alias("price"), "after.note", "version"
    )


def _order_chunks(spark: SparkSession, sf_dir: str) -> KeyChunks:
    last = X.table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return KeyChunks("id", tuple(last * k // CHUNKS for k in range(1, CHUNKS)))


def _rows_while_read(changes: DataFrame, chunks: KeyChunks) -> DataFrame:
    """Each chunk of the orders as a slow reading shows it: rows with an even key as of its
    beginning, the others as of its end."""
    key = F.coalesce("after.id", "before.id")
    read = F.lit(CHUNK_READ_MS) + chunks.number(key) * F.lit(CHUNK_EVERY_MS)
    seen = F.when(key % 2 == 0, read).otherwise(read + F.lit(CHUNK_TAKES_MS))
    return C.current_state(changes.where(F.col("ts_ms") <= seen), ["id"], CHANGE_ORDER)


def cdc_chunked_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read in eight chunks at different times, joined to the changes around them."""
    changes, chunks = _order_changes(spark, sf_dir), _order_chunks(spark, sf_dir)
    lows = [CHUNK_READ_MS + c * CHUNK_EVERY_MS for c in range(CHUNKS)]
    marks = spark.createDataFrame(
        [(c, low, low + CHUNK_TAKES_MS) for c, low in enumerate(lows)],
        "chunk int, low bigint, high bigint",
    )
    rows = _rows_while_read(changes, chunks)
    events = chunks_then_changes(
        rows, marks, changes, X.DATABASE, "orders", ["id"], ["ts_ms", "seq"], chunks
    )
    return _event_columns(events)


def cdc_chunked_capture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same beside the running feed: each chunk is read after a micro-batch of it; the
    job is stopped after each."""
    feed, changes = X.database_changes(spark, sf_dir), _order_changes(spark, sf_dir)
    chunks = _order_chunks(spark, sf_dir)
    out, landed, table = (new_folder(spark, n) for n in ("chunked", "landed", "table"))
    _rows_while_read(changes, chunks).write.parquet(table)
    rows, now = spark.read.parquet(table), [0]

    def read_chunk(chunk: int) -> DataFrame:
        now[0] = CHUNK_READ_MS + chunk * CHUNK_EVERY_MS + CHUNK_TAKES_MS
        return rows.where(chunks.condition(chunk))

    ts = F.get_json_object("value", "$.ts_ms").cast("bigint")
    past = F.floor((ts - CHUNK_READ_MS - 1) / CHUNK_EVERY_MS) + 1
    part = F.least(F.greatest(past, F.lit(0)), F.lit(CHUNKS))
    parted = new_folder(spark, "parted")
    feed.withColumn("part", part).write.partitionBy("part").parquet(parted)
    arrived = spark.read.parquet(parted)
    for n in range(CHUNKS + 1):
        # All files of a part are one micro-batch, so that its rows are spread over the tasks.
        some = arrived.where(F.col("part") == n).select(*feed.columns)
        some.write.mode("append").parquet(landed)
        stream = read_landed(spark, landed, feed.schema, stream=True)
        start_chunked_capture(
            C.parse_changes(stream, ORDER_ROW),
            X.DATABASE,
            "orders",
            ["id"],
            ["ts_ms", "seq"],
            chunks,
            read_chunk,
            lambda: now[0],
            JobOptions(checkpoint=f"{out}-checkpoint", available_now=True),
            out,
        )
    return _event_columns(read_chunked_capture(spark, out))


def _written_twice(spark: SparkSession, sf_dir: str, out: str) -> None:
    """Split logs appended to ``out`` by a job that fails after it has written a micro-batch
    and is started again: that batch is there twice."""
    failed = []

    def append(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("append").parquet(out)
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("lost after writing")

    def start(stream: DataFrame, job: JobOptions) -> StreamingQuery:
        writer = split_logs(stream, LOG_ORDER).writeStream.foreachBatch(append)
        try:
            return job.start(writer)
        except StreamingQueryException:
            return job.start(writer)

    logs = X.app_logs(spark, sf_dir)
    _in_two_arrivals(logs, _half_time(logs), start)


def sink_repeats_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "repeated")
    _written_twice(spark, sf_dir, out)
    return _topic_totals(without_repeats(spark.read.parquet(out), "1 day"))


def sink_repeats_dropped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per topic of what a job wrote twice, read once by a stream."""
    repeated, out = new_folder(spark, "repeated"), new_folder(spark, "once")
    _written_twice(spark, sf_dir, repeated)
    written = spark.read.parquet(repeated)
    # The number of files follows the writer's tasks; that of micro-batches must not.
    files = max(2, -(-len(written.inputFiles()) // READINGS))
    stream = read_landed(spark, repeated, written.schema, stream=True, max_files=files)
    rows = without_repeats(stream, "1 day").writeStream.format("parquet").option("path", out)
    JobOptions(checkpoint=f"{out}-checkpoint", available_now=True).start(rows)
    return _topic_totals(spark.read.parquet(out))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        log_json_validity,
        log_dirty_route,
        log_is_new_corrected,
        log_is_new_stream,
        log_start_route,
        log_page_route,
        log_page_odd,
        log_display_route,
        log_display_exact,
        log_topic_fanout,
        log_topic_fanout_stream,
        cdc_raw_events,
        cdc_format_after,
        cdc_format_full,
        cdc_format_exact,
        cdc_capture_stream,
        cdc_snapshot_union,
        cdc_snapshot_overlap,
        cdc_select_star,
        cdc_retract,
        cdc_retract_stream,
        cdc_current_state,
        cdc_current_state_stream,
        cdc_net_rows,
        cdc_rejected_events,
        cdc_current_state_faulty,
        cdc_unplaced_events,
        cdc_initial_capture_stream,
        cdc_current_rekeyed,
        cdc_current_rekeyed_stream,
        cdc_net_rekeyed,
        cdc_retract_new_rows,
        cdc_retract_new_rows_stream,
        cdc_net_new_rows,
        cdc_evolving_stream,
        cdc_chunked_union,
        cdc_chunked_capture_stream,
        sink_default_topic,
        sink_repeats_dropped,
        sink_repeats_dropped_stream,
    )
}
