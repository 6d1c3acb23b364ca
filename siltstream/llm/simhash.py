"""SimHash near-duplicates by the pigeonring principle (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.llm.buckets import cells, linked
from siltstream.llm.packing import chunks
from siltstream.llm.shared import components, in_small_batches, saved, text_hash

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Segments of a fingerprint, 16 bits each, in a ring.
SEGMENTS = 4
#: Hashes whose bits are counted at a time.
SLICE = 1 << 16


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of the 3-word shingles of a text, repeats included.

    A-Z are lower-cased; words are what ASCII white space parts. A bit is set if it is set in
    over half the XXH64 hashes. Up to two words are one shingle; no word gives 0.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = list(accumulate(len(word) + 1 for word in words))
    starts = [0, *ends[:-SHINGLE]]
    ends = ends[SHINGLE - 1 :] or ends[-1:]
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), SLICE):
        pairs = zip(starts[at : at + SLICE], ends[at : at + SLICE])
        hashes = np.array([digest(data[a : b - 1], SEED) for a, b in pairs], "<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id``, the fingerprint of ``text`` as a signed long and the hash of all of it; a
    null text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches):
            found = np.array([fingerprint(text) for text in texts], np.uint64).view(np.int64)
            docs, hashes = ([key[name] for key in keys] for name in ("doc_id", "text_hash"))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "bits": found, "text_hash": pa.array(hashes, pa.int64())})

    rows = documents.select(F.struct("doc_id", text_hash().alias("text_hash")).alias("key"), "text")
    return in_small_batches(rows).mapInArrow(run, "doc_id long, bits long, text_hash long")


def segment(bits: Column, k: int, width: int = 16, offset: int = 0) -> Column:
    """``width`` bits of segment ``k`` of the ring, from bit ``offset`` of the segment."""
    return F.shiftrightunsigned(bits, 16 * (k % SEGMENTS) + offset).bitwiseAND((1 << width) - 1)


def ring_keys(bits: Column) -> Column:
    """The keys under which two fingerprints at 3 or fewer differing bits must meet.

    By the strong pigeonring principle with 4 segments, some chain of segments starts with
    one that is equal (at most 3/4 bits differ), and the next differs in at most one bit
    (at most 6/4 in both). One half of that next segment is then equal as well, so the keys
    are a segment and a half of the next: 24 bits and the place, 8 for each fingerprint.
    """
    keys = []
    for k in range(SEGMENTS):
        for half in range(2):
            value = F.shiftleft(segment(bits, k), 8).bitwiseOR(segment(bits, k + 1, 8, 8 * half))
            keys.append(value.bitwiseOR(F.lit((2 * k + half) << 24)))
    return F.array(*keys)


def ring_links(values: list[int], distance: int = DISTANCE) -> np.ndarray:
    """Which of the fingerprints differ in at most ``distance`` bits.

    A pair counts its bits only if from some segment on the differences of 1, 2, 3 and 4
    consecutive segments stay within their share of the distance.
    """
    bits = np.array(values, np.int64).view(np.uint64)
    out = np.zeros((len(bits), len(bits)), bool)
    for at in range(0, len(bits), 256):
        apart = bits[at : at + 256, None] ^ bits[None, :]
        parts = [np.bitwise_count((apart >> np.uint64(16 * k)) & np.uint64(0xFFFF)) for k in range(SEGMENTS)]
        holds = np.zeros(apart.shape, bool)
        for start in range(SEGMENTS):
            chain, total = np.ones(apart.shape, bool), np.zeros(apart.shape, np.uint8)
            for length in range(1, SEGMENTS):
                total = total + parts[(start + length - 1) % SEGMENTS]
                chain &= total * SEGMENTS <= length * distance
            holds |= chain
        rows, columns = np.nonzero(holds)
        near = np.bitwise_count(apart[rows, columns]) <= distance
        out[at + rows[near], columns[near]] = True
    np.fill_diagonal(out, False)
    return out


def near_groups(documents: DataFrame) -> DataFrame:
    """Groups documents whose fingerprints are linked, directly or through others.

    Returns ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the
    smallest ``doc_id`` of the group.

    Equal fingerprints are one class from the start, so copies never meet in pairs. Classes
    are compared in buckets of :func:`ring_keys`; a bucket of any size is cut into cells.

    Repeated rows keep a row each. A null ``doc_id`` gets a row and names a group only if no
    other does. Null and blank texts have fingerprint zero and are linked like any other. An
    empty table gives no rows; other columns are not read.
    """
    return grouped(documents).select("doc_id", hex16(F.col("bits")).alias("fingerprint"), "component_id")


def grouped(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``bits``, ``text_hash`` and the ``component_id`` of :func:`near_groups`."""
    rows = saved(fingerprints(documents), "fingerprints")
    classes = rows.groupBy("bits").agg(F.min("doc_id").alias("first"))
    keyed = classes.select("bits", F.explode(ring_keys(F.col("bits"))).alias("key"))
    links = linked(cells(keyed, ["key"], "bits"), ["key"], "bits", "bits", ring_links)
    found = components(links)
    classes = classes.join(found.withColumnRenamed("node", "bits"), "bits", "left")
    classes = classes.withColumn("component", F.coalesce("component", "bits"))
    names = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    names = classes.join(names, "component").select("bits", "component_id")
    return rows.join(names, "bits")


def one_of_each(documents: DataFrame) -> DataFrame:
    """Of each group of :func:`near_groups` the document with the smallest ``doc_id``.

    Rows with the same ``doc_id`` and text are one document; rows that repeat a ``doc_id``
    with other texts are documents of their own, of which one stays if they are near copies.
    Rows without a ``doc_id`` take no part and stay, one for each text. All columns are kept.
    """
    groups = grouped(documents.where("doc_id is not null"))
    kept = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    others = groups.join(saved(kept, "kept"), "component_id").where(F.struct("doc_id", "text_hash") != F.col("kept"))
    others = others.select(F.col("doc_id").alias("_other"), F.col("text_hash").alias("_other_hash")).distinct()
    # The row in one column, so that no name of its own clashes with those used here.
    rows = documents.select(F.struct(*documents.columns).alias("row"), "doc_id", text_hash().alias("hash"))
    same = (rows["doc_id"] == others["_other"]) & (rows["hash"] == others["_other_hash"])
    return rows.join(others, same, "left_anti").dropDuplicates(["doc_id", "hash"]).select("row.*")


def hex16(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
