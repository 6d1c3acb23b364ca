"""Benchmark passages in documents, by greedy string tiling (operator 9)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.llm.packing import chunks
from siltstream.llm.shared import in_small_batches
from siltstream.llm.words import Words, grams

#: Words of the shortest tile, and of the seeds that join documents with items.
SEED_WORDS = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.8
#: Characters of benchmark text that are sent to the executors at a time.
BLOCK_CHARS = 4_000_000
#: Size of the bitmap that passes over most words of a document.
BITMAP = 1 << 22

TILES = "array<struct<doc_word: long, item_word: long, words: long>>"


class Seeds:
    """The word runs of a block of benchmark items, by hash."""

    def __init__(self, items: list[tuple[int, str]], seed_words: int = SEED_WORDS) -> None:
        self.seed_words = seed_words
        self.items = [(item, Words(text or "", letters=True).hashes) for item, text in items]
        found = [grams(hashes, seed_words) for _, hashes in self.items]
        values = np.concatenate([*found, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
        place = np.concatenate([*(np.arange(len(f)) for f in found), np.zeros(0, np.int64)])
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.place = values[order], owner[order], place[order].astype(np.int64)
        self.bitmap = np.zeros(BITMAP, bool)
        self.bitmap[values & np.uint64(BITMAP - 1)] = True

    def tiles(self, text: str) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """``(item, its words, tiles)`` for every item that shares a seed with the text."""
        words = Words(text, letters=True).hashes
        runs = grams(words, self.seed_words)
        at = np.flatnonzero(self.bitmap[runs & np.uint64(BITMAP - 1)])
        if not len(at):
            return
        first = np.searchsorted(self.values, runs[at], "left")
        count = np.searchsorted(self.values, runs[at], "right") - first
        at = np.repeat(at, count)
        entry = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        owner = self.owner[entry]
        for k in np.unique(owner):
            mine = owner == k
            item, pattern = self.items[k]
            yield item, len(pattern), tile(words, pattern, at[mine], self.place[entry[mine]], self.seed_words)


def tile(
    text: np.ndarray, pattern: np.ndarray, at: np.ndarray, place: np.ndarray, least: int
) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(word of the text, word of the pattern, words)`` of each tile.

    ``at`` and ``place`` are where both have the same hash of ``least`` words. Over and over
    the longest matches of words that are in no tile yet become tiles, the earliest in the
    pattern and then in the text first, until none has ``least`` words.
    """
    step = np.arange(least)
    same = (text[at[:, None] + step] == pattern[place[:, None] + step]).all(axis=1)
    at, place = at[same], place[same]
    order = np.lexsort((at, at - place))
    at, place = at[order], place[order]
    in_text, in_pattern = np.zeros(len(text), bool), np.zeros(len(pattern), bool)
    out: list[tuple[int, int, int]] = []
    while len(at):
        # Seeds one after another on a diagonal are one maximal match.
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at - place) != 0) | (np.diff(at) != 1)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at))) + least - 1
        longest = int(size.max())
        begin = begin[size == longest]
        for k in begin[np.lexsort((at[begin], place[begin]))]:
            a, p = int(at[k]), int(place[k])
            if in_text[a : a + longest].any() or in_pattern[p : p + longest].any():
                continue
            in_text[a : a + longest] = in_pattern[p : p + longest] = True
            out.append((a, p, longest))
        if in_pattern.all():
            break
        free = ~(in_text[at[:, None] + step].any(axis=1) | in_pattern[place[:, None] + step].any(axis=1))
        at, place = at[free], place[free]
    return sorted(out, key=lambda t: t[1])


def tilings(
    documents: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    seed_words: int = SEED_WORDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Pairs of a document and a benchmark item whose words tiles of the document cover to
    at least ``coverage``, wherever in the document and in whatever order they stand.

    Returns ``doc_id``, ``item_id``, ``item_words``, ``covered`` words, ``coverage`` and the
    ``tiles``. Words are runs of letters and digits in lower case.

    The items are dealt by hash into blocks of about ``block_chars`` characters; the seeds
    of one block at a time go to the executors, and each block meets all documents. So what
    is sent out stays bounded, and a benchmark of one block reads the documents once.

    Null and empty texts have no words and share nothing. Items of fewer than ``seed_words``
    words have no seed and are never found. Repeated documents or items give repeated rows;
    null ids stay null. An empty table on either side gives no rows. Only ``doc_id`` and
    ``text``, ``item_id`` and ``text`` are read.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("item_id", pa.int64()),
            ("item_words", pa.int64()),
            ("covered", pa.int64()),
            ("coverage", pa.float64()),
            ("tiles", pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))),
        ]
    )

    def against(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(items, seed_words)
            for docs, texts in chunks(batches):
                rows = []
                for doc, text in zip(docs, texts):
                    for item, words, found in seeds.tiles(text):
                        covered = sum(t[2] for t in found)
                        if found and covered >= coverage * words:
                            tiles = [dict(zip(("doc_word", "item_word", "words"), t)) for t in found]
                            rows.append((doc, item, words, covered, covered / words, tiles))
                columns = list(zip(*rows)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
                )

        return in_small_batches(documents.select("doc_id", "text")).mapInArrow(
            run,
            f"doc_id long, item_id long, item_words long, covered long, coverage double, tiles {TILES}",
        )

    items = benchmark.select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        rows = items.where(F.col("block") == block).collect()
        part = against([(row["item_id"], row["text"]) for row in rows])
        out = part if out is None else out.union(part)
    return out
