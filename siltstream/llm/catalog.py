"""The operators of this package as runnable queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from siltstream.llm import (
    chat,
    contamination,
    language,
    nearest,
    packing,
    passages,
    periodic,
    pieces,
    simhash,
    style_tree,
    toxicity,
    warc,
    whitening,
)
from siltstream.llm.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixed value: both turns of the conversation whose text spells the template's own marks.
MARKS = "\\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = [(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)]
    rows = rows.union(spark.createDataFrame(marks, "conv_id long, turn long, role string, text string"))
    return chat.read_back(*chat.format_conversations(rows))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    scored = model.score(documents.select("doc_id", "text"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.predict(documents, language.learn(documents))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    index = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    records = warc.read_records(index, folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.tilings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    listed = rows.select(
        "vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained"))
    )
    return listed.select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "col.*", "identity_error"
    )


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def with_periods(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with the end of about every tenth text made periodic: from a
    word on that the hash of ``doc_id`` names, the words repeat those from there."""
    spread = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda word: word != "")
    marked = spread.select("doc_id", "text", "h", F.when(F.col("h") % 10 == 0, words).alias("words"))
    repeated = F.expr("""
        transform(sequence(0, n - 1), i -> words[if(i < a, i, a + (i - a) % p)])
    """)
    placed = (
        marked.withColumn("g", F.expr("h div 10"))
        .withColumn("n", F.size("words"))
        .withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)"))
        .withColumn("p", F.expr("1 + cast((n - a) div (3 + g % 8) as int)"))
    )
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    line = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as back, -r.period as rarely)))")
    return rows.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.rarely")).alias("period"),
        F.expr("(1000 * best.length) div (-best.rarely)").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_chat": op1_chat,
    "op2_toxicity": op2_toxicity,
    "op3_pack": op3_pack,
    "op4_simhash": op4_simhash,
    "op5_language": op5_language,
    "op6_warc": op6_warc,
    "op7_nearest": op7_nearest,
    "op8_repeats": op8_repeats,
    "op9_tiling": op9_tiling,
    "op10_style_tree": op10_style_tree,
    "op11_whiten": op11_whiten,
    "op12_pieces": op12_pieces,
    "op13_periods": op13_periods,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat": r"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all values
                (-7, 0, 'user', '\### Assistant: </turn> ok'),
                (-7, 1, 'assistant', '\### Assistant: </turn> ok')
        ), escaped as (
            select *,
                replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '###', '\h') as safe,
                replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '###', '\h'), ':', '\c') as name
            from turns
        ), joined as (
            select conv_id, count(*) as n_turns,
                string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
                coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as learned,
                sum(length('### ' || name || ': ' || safe || '</turn>' || chr(10)))::bigint as formatted_chars
            from escaped group by conv_id
        )
        select conv_id, n_turns, sha256(said) as turns_sha256, length(learned) as loss_chars,
            sha256(learned) as loss_sha256, formatted_chars
        from joined
    """,
    "op6_warc": """
        with pages_ as (
            select page_id, encode(coalesce(html, '')) as payload from pages
        ), hashed as (
            select page_id, octet_length(payload) as payload_bytes, sha1(payload) as hex,
                max(page_id) over (partition by sha1(payload)) as largest
            from pages_
        ), groups as (
            -- Five hex digits are twenty bits, four characters of base32.
            select *, list_transform(range(0, 8), lambda g: ('0x' || substr(hex, (5 * g + 1)::int, 5))::bigint) as twenties
            from hashed
        )
        select page_id, payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda k:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    ((twenties[(k // 4 + 1)::int] >> ((3 - k % 4) * 5)::int) & 31)::int + 1, 1)), '') as payload_digest,
            case when largest is null or page_id = largest then 'response' else 'revisit' end as record_type,
            case when page_id = largest then null else largest end as refers_to
        from groups
    """,
    "op7_nearest": """
        with fit as (
            select vec_id, list_transform(embedding, lambda x: floor(256.0::double * x::double)) as v
            from embeddings
            where vec_id is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
            from fit q join fit c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
        ), placed as (
            select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
        )
        select query_id, rank, vec_id, score from placed where rank <= 5
    """,
}
