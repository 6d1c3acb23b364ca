"""Conversations as token trees in which shared first turns stand once (operator 1)."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstream.llm.shared import saved

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

# The template: a turn is START, its role, MIDDLE, its text, END. Only assistant text is
# under the loss mask.
START, MIDDLE, END = "### ", ": ", "</turn>\n"
LEARNED = "assistant"

#: Escapes, in the order in which they are applied. No text holds "###" or "</turn>"
#: afterwards, and a backslash always begins an escape.
ESCAPES = (("\\", "\\\\"), ("</turn>", "\\e"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
MEANING = {new: old for old, new in ROLE_ESCAPES}
ESCAPED = re.compile(r"\\.")
TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*)" + re.escape(END), re.DOTALL)

SPAN = "array<struct<start: long, end: long>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escaped(text: str, pairs: tuple = ESCAPES) -> str:
    for old, new in pairs:
        text = text.replace(old, new)
    return text


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda found: MEANING[found[0]], text)


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer_of(path: str) -> Tokenizer:
    """One per worker process and file, without threads of its own; special tokens' strings
    are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    return _tokenizers[path]


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns with their ``depth`` in the conversation and the ``node`` of the prefix tree
    they belong to: a hash of all turns up to this one.

    A conversation streams through one task in order; only the last hash is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, node, depth = object(), b"", 0
        for batch in batches:
            nodes, depths = [], []
            columns = (batch.column(k).to_pylist() for k in range(3))
            for conv, role, text in zip(*columns):
                if conv != before:
                    before, node, depth = conv, b"", 0
                role, text = role.encode(), text.encode()
                head = len(role).to_bytes(8, "big")
                node = hashlib.blake2b(node + head + role + text, digest_size=16).digest()
                nodes.append(node)
                depths.append(depth)
                depth += 1
            columns = [batch.column(0), pa.array(depths, pa.int64()), pa.array(nodes, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*columns, batch.column(1), batch.column(2)], ["conv_id", "depth", "node", "role", "text"]
            )

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        "turn",
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", "role", "text")
    return rows.mapInArrow(run, "conv_id long, depth long, node binary, role string, text string")


def depth_first(turns: DataFrame) -> DataFrame:
    """``(conv_id, rank)``: ranks follow a depth-first walk of the prefix trees.

    Conversations are sorted by the nodes they share with others. Those that pass through a
    node are neighbours then, so its subtree is contiguous. Equal keys follow the id.
    """
    # Written, so that the join's sides are plain shuffles and a hot first turn is split.
    shared = turns.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    shared = saved(shared, "shared")
    path = F.array_sort(F.collect_list(F.struct("depth", F.hex("node").alias("node"))))
    keys = turns.select("conv_id", "depth", "node").join(shared, "node").groupBy("conv_id").agg(path.alias("path"))
    keys = keys.select("conv_id", F.array_join("path.node", "").alias("key"))
    convs = turns.select("conv_id").where("conv_id is not null").distinct().join(keys, "conv_id", "left")
    # The conversation of rows without an id is one more.
    convs = convs.union(turns.where("conv_id is null").limit(1).select("conv_id", F.lit(None).cast("string")))
    convs = convs.withColumn("key", F.coalesce("key", F.lit("")))
    convs = convs.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return convs.select("conv_id", F.monotonically_increasing_id().alias("rank"))


def tokenized(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """Token ids of each node's formatted turn, the part under the loss mask, and where the
    node starts among those of the same task. Rows come sorted by ``rank`` and ``depth``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = tokenizer_of(tokenizer).encode_batch_fast, TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                nodes, roles, texts = (rows.column(name).to_pylist() for name in ("node", "role", "text"))
                heads = [START + escaped(role, ROLE_ESCAPES) + MIDDLE for role in roles]
                pieces = [x for head, text in zip(heads, texts) for x in (head, escaped(text), END)]
                ids = [x.ids for x in encode(pieces, add_special_tokens=False)]
                out = {"node": pa.array(nodes, pa.binary()), "role": rows.column("role")}
                out["part"] = pa.array([part] * len(nodes), pa.int64())
                starts, whole, begin, end = [], [], [], []
                for j, role in enumerate(roles):
                    head, body, tail = ids[3 * j : 3 * j + 3]
                    learned = role == LEARNED
                    starts.append(at)
                    whole.append(head + body + tail)
                    begin.append(len(head) if learned else 0)
                    end.append(len(head) + len(body) if learned else 0)
                    at += len(whole[-1])
                out |= {"local": pa.array(starts, pa.int64()), "ids": pa.array(whole, pa.list_(pa.int32()))}
                out |= {"loss_start": pa.array(begin, pa.int64()), "loss_end": pa.array(end, pa.int64())}
                yield pa.RecordBatch.from_pydict(out)

    return nodes.mapInArrow(
        run,
        "node binary, role string, part long, local long, ids array<int>, loss_start long, loss_end long",
    )


def attention(paths: DataFrame) -> DataFrame:
    """For each node that a conversation is the first to pass: the position id of its first
    token and the intervals of its ancestors, neighbours joined.

    ``paths`` are turns with ``start`` and ``size`` of their node, and ``own``. They stream
    through a task in order; the intervals of one conversation are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, position, spans = object(), 0, []
        for batch in batches:
            names = ("conv_id", "node", "start", "size", "own")
            rows = []
            for conv, node, start, size, own in zip(*(batch.column(n).to_pylist() for n in names)):
                if conv != before:
                    before, position, spans = conv, 0, []
                if own:
                    rows.append((node, position, [dict(zip(("start", "end"), s)) for s in spans]))
                position += size
                if spans and spans[-1][1] == start:
                    spans[-1] = (spans[-1][0], start + size)
                else:
                    spans.append((start, start + size))
            columns = list(zip(*rows)) or [[]] * 3
            types = (pa.binary(), pa.int64(), SPAN_TYPE)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "position_start", "attends"])

    rows = paths.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return rows.mapInArrow(run, f"node binary, position_start long, attends {SPAN}")


def format_conversations(conversations: DataFrame, tokenizer: str = BYTE_BPE) -> tuple[DataFrame, DataFrame]:
    """Merges conversations that share first turns into prefix trees and writes each shared
    turn once, depth first.

    Returns two tables. *Segments*, one per node of the trees: ``node``, ``role``, ``start``
    (its first token among those of all segments; the trees follow one another), ``ids``,
    ``loss_start`` and ``loss_end`` (the part of ``ids`` under the loss mask),
    ``position_start`` (the position id of its first token: the tokens of its ancestors) and
    ``attends`` (the intervals of its ancestors' tokens; its tokens also see those before
    them in the segment). *Paths*: ``conv_id``, ``depth`` and ``node`` of every turn.

    Turns of a conversation follow ``turn``, then ``role`` and ``text``; repeated rows are
    turns of their own, a null ``turn`` comes first. Null roles and texts are empty. Rows
    without ``conv_id`` are one conversation. An empty table gives two empty ones. Other
    columns are not read.

    No conversation or tree is gathered: conversations stream through tasks in order, nodes
    that many pass are joined to them by joins whose skewed partitions are split.
    """
    spark = conversations.sparkSession
    turns = saved(numbered(conversations), "turns")
    ranks = saved(depth_first(turns), "ranks")
    same = turns["conv_id"].eqNullSafe(ranks["conv_id"])
    ranked = turns.join(ranks, same).select(turns["*"], "rank")
    owners = saved(ranked.groupBy("node").agg(F.min("rank").alias("owner")), "owners")
    ranked = saved(ranked.join(owners, "node").withColumn("own", F.col("rank") == F.col("owner")), "ranked")
    nodes = ranked.where("own").select("rank", "depth", "node", "role", "text")
    nodes = nodes.repartitionByRange("rank", "depth").sortWithinPartitions("rank", "depth")
    nodes = saved(tokenized(nodes, tokenizer), "nodes").withColumn("size", F.size("ids").cast("long"))
    # One number for each task that wrote nodes.
    totals, before, at = nodes.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect(), [], 0
    for row in totals:
        before.append((row["part"], at))
        at += row["size"]
    before = spark.createDataFrame(before, "part long, before long")
    nodes = nodes.join(F.broadcast(before), "part").withColumn("start", F.col("local") + F.col("before"))
    places = nodes.select("node", "start", "size")
    paths = ranked.select("conv_id", "depth", "node", "own")
    seen = attention(paths.join(places, "node"))
    segments = nodes.join(seen, "node").select(
        "node", "role", "start", "ids", "loss_start", "loss_end", "position_start", "attends"
    )
    return segments, paths.drop("own")


def read_back(segments: DataFrame, paths: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """What each conversation says, decoded from the segments on its path: ``conv_id``,
    ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    Hashes are fed turn by turn as a conversation streams through a task.
    """
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokenizer_of(tokenizer).decode
        before, rows = object(), []
        turns = all_text = loss = None
        count = learned = chars = 0

        def done() -> None:
            if count:
                rows.append((before, count, turns.hexdigest(), learned, loss.hexdigest(), chars))

        names = ("conv_id", "ids", "loss_start", "loss_end")
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                for conv, ids, start, end in zip(*(part.column(n).to_pylist() for n in names)):
                    if conv != before:
                        done()
                        before, turns, loss = conv, hashlib.sha256(), hashlib.sha256()
                        count = learned = chars = 0
                    all_text = decode(ids, skip_special_tokens=False)
                    role, text = TURN.fullmatch(all_text).groups()
                    turns.update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
                    under_mask = unescaped(decode(ids[start:end], skip_special_tokens=False))
                    loss.update(under_mask.encode())
                    count, learned, chars = count + 1, learned + len(under_mask), chars + len(all_text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows.clear()
        done()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = paths.join(segments.select("node", "ids", "loss_start", "loss_end"), "node")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return rows.select("conv_id", "ids", "loss_start", "loss_end").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
