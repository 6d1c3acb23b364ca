"""Repeated paragraphs and passages, by banded MinHash and content-defined cuts (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.llm.buckets import cells, linked
from siltstream.llm.packing import chunks
from siltstream.llm.shared import components, in_small_batches, saved, sent_if_small, text_hash
from siltstream.llm.words import Words, grams, mixed, random_odd, read_together

#: Words of a shingle, and the Jaccard similarity of shingle sets that links two paragraphs.
SHINGLE = 5
SIMILARITY = 0.8
#: Paragraphs of fewer words are left alone: short lines repeat by nature.
LEAST_WORDS = 20
#: 8 bands of 3 rows find a pair at the similarity of 0.8 with probability 0.997.
BANDS, ROWS = 8, 3
#: Words of a passage, and the words among which one passage starts at least. A run of
#: PASSAGE + SPAN words that two texts share holds a passage both have cut alike.
PASSAGE, SPAN = 28, 20

PERMUTE = random_odd(BANDS * ROWS, 2)
SHIFT = random_odd(BANDS * ROWS, 3)
PLACES = 1 << 28

UNIT = "hash long, doc_id long, text_hash long, start long, end long, bands array<long>"
PLACE = ["doc_id", "text_hash", "start", "end"]
HIT = [*PLACE, "kept_doc_id", "kept_text", "kept_start", "kept_end", "cluster_id"]
HIT_SCHEMA = pa.schema([(name, pa.int64()) for name in HIT])
AROUND = ["before", "back", "after", "ahead"]
CONTEXT = ", ".join([*(f"{name} long" for name in PLACE), *(f"{name} array<int>" for name in AROUND)])
CONTEXT_SCHEMA = pa.schema([*((name, pa.int64()) for name in PLACE), *((name, pa.list_(pa.int32())) for name in AROUND)])
UNIT_SCHEMA = pa.schema(
    [
        ("hash", pa.int64()),
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("bands", pa.list_(pa.int64())),
    ]
)


def paragraphs(words: Words, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and numbers of words of the lines with ``least_words`` words or more."""
    breaks = np.flatnonzero((words.codes == 10) | (words.codes == 13))
    heads = np.zeros(len(words) + 1, bool)
    heads[0] = True
    heads[np.searchsorted(words.starts, breaks)] = True
    first = np.flatnonzero(heads[:-1])
    count = np.diff(np.append(first, len(words)))
    long = count >= least_words
    return first[long], count[long]


def whole_hashes(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of all words of each paragraph."""
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    values = mixed(hashes[np.repeat(first, count) + inside] + mixed(inside.astype(np.uint64)))
    return mixed(np.add.reduceat(values, np.cumsum(count) - count) + count.astype(np.uint64))


def shingles(words: Words, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of paragraphs one after another, and where each one's begin."""
    count = count - SHINGLE + 1
    begin = np.cumsum(count) - count
    at = np.repeat(first - begin, count) + np.arange(count.sum())
    return grams(words.hashes, SHINGLE, at), begin


def band_hashes(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of band hashes for each paragraph, from the least shingle under each permutation."""
    out = np.zeros((len(begin), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat((values ^ SHIFT[k]) * PERMUTE[k], begin)
        out[:, k // ROWS] = mixed(out[:, k // ROWS] + least)
    return out


def passage_starts(hashes: np.ndarray, passage: int, span: int, counts: np.ndarray | None = None) -> np.ndarray:
    """Words at which passages start: the least of every ``span`` hashes of word pairs, so
    that equal texts are cut alike wherever they stand (winnowing). With ``counts`` the words
    are those of several texts, and no passage runs from one into the next."""
    counts = np.array([len(hashes)]) if counts is None else counts
    pairs = grams(hashes, 2)
    if len(hashes) < passage + span:
        return np.zeros(0, np.int64)
    places = np.arange(len(pairs), dtype=np.uint64)
    least = (pairs & ~np.uint64(PLACES - 1)) | places
    done = 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    ends = np.repeat(np.cumsum(counts), counts)
    # All pairs of the window are in one text, which is long enough.
    whole = (places[: len(least)].astype(np.int64) + span < ends[: len(least)]) & (np.repeat(counts, counts)[: len(least)] >= passage + span)
    found = np.zeros(len(hashes), bool)
    found[(least[whole] & np.uint64(PLACES - 1)).astype(np.int64)] = True
    starts = np.flatnonzero(found)
    return starts[starts + passage <= ends[starts]]


def units(documents: DataFrame, least_words: int, passage: int, span: int) -> DataFrame:
    """Paragraphs (with bands) and passages (without) of all documents: a hash of the words
    and the place in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, texts in chunks(batches):
            known = [k for k, doc in enumerate(docs) if doc["doc_id"] is not None]
            docs, texts = [docs[k] for k in known], [texts[k] for k in known]
            keys = [np.array([doc[name] for doc in docs], np.int64) for name in ("doc_id", "text_hash")]
            lines, bands, runs = [], [], []
            for part in read_together(texts):
                words = Words(texts[part])
                own = [key[part] for key in keys]
                first, count = paragraphs(words, least_words)
                if len(first):
                    bands.append(band_hashes(*shingles(words, first, count)))
                    lines.append(unit_columns(words, own, first, count, whole_hashes(words.hashes, first, count)))
                first = passage_starts(words.hashes, passage, span, words.counts)
                if len(first):
                    runs.append(unit_columns(words, own, first, passage, grams(words.hashes, passage, first)))
            if lines:
                yield unit_batch(lines, np.concatenate(bands))
            if runs:
                yield unit_batch(runs, None)

    rows = documents.select(F.struct("doc_id", text_hash().alias("text_hash")).alias("key"), "text")
    return in_small_batches(rows).mapInArrow(run, UNIT)


def unit_columns(words: Words, keys: list[np.ndarray], first: np.ndarray, count: np.ndarray | int, hashes: np.ndarray) -> list[np.ndarray]:
    """Runs of words of several texts as columns: their hashes, the keys of their texts, and
    where they start and end in these."""
    owner = np.searchsorted(words.firsts, first, "right") - 1
    start, end = words.starts[first], words.ends[first + count - 1]
    return [hashes.view(np.int64), *(key[owner] for key in keys), start - words.begins[owner], end - words.begins[owner]]


def unit_batch(parts: list[list[np.ndarray]], bands: np.ndarray | None) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(column)) for column in zip(*parts)]
    if bands is None:
        bands = pa.nulls(len(columns[0]), pa.list_(pa.int64()))
    else:
        bounds = np.arange(len(bands) + 1, dtype=np.int32) * BANDS
        bands = pa.ListArray.from_arrays(bounds, bands.view(np.int64).ravel())
    return pa.RecordBatch.from_arrays([*columns, bands], schema=UNIT_SCHEMA)


def jaccard_links(sets: pa.ListArray | list[list[int]], similarity: float) -> np.ndarray:
    """Which of the sets are at the Jaccard similarity or above."""
    sets = sets if isinstance(sets, pa.ListArray) else pa.array(sets, pa.list_(pa.int64()))
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    _, value = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    # Only values that several sets have count in an intersection.
    several = np.bincount(value)[value] > 1
    owner, value = owner[several], value[several]
    both = np.zeros((len(sets), len(sets)), np.float32)
    last = int(value[-1]) + 1 if len(value) else 0
    width = min(4096, last)
    for at in range(0, last, 4096):
        a, b = np.searchsorted(value, [at, at + width])
        if a < b:
            has = np.zeros((len(sets), width), np.float32)
            has[owner[a:b], value[a:b] - at] = 1
            both += has @ has.T
    out = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-4
    np.fill_diagonal(out, False)
    return out


def near_links(documents: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Links between classes of equal paragraphs whose shingle sets are near: those that
    share a band are compared by their whole sets, which are cut out of the first
    paragraph of the class again, for these classes only."""
    size = (F.col("first.end") - F.col("first.start")).alias("size")
    keyed = classes.select("hash", size, F.posexplode("bands").alias("band", "value"))
    dealt = saved(cells(keyed, ["band", "value"], "hash", weight=F.col("size")).drop("size"), "cells")
    wanted = dealt.select("hash").distinct().join(classes, "hash")
    wanted = wanted.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")).agg(
        F.collect_list(F.struct("hash", "first.start", "first.end")).alias("places")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(batch.column(0), batch.column(1)):
                # The paragraphs of a document in lines of their own, read in one go.
                text, places = text.as_py() or "", places.as_py()
                pieces = [text[place["start"] : place["end"]] for place in places]
                bounds = np.cumsum([len(piece) + 1 for piece in pieces])
                words = Words("\n".join(pieces))
                owner = np.searchsorted(bounds, words.starts, "right")
                count = np.bincount(owner, minlength=len(pieces))
                full = np.flatnonzero(count >= SHINGLE)
                if not len(full):
                    continue
                values, begin = shingles(words, (np.cumsum(count) - count)[full], count[full])
                sets = [np.unique(part).view(np.int64) for part in np.split(values, begin[1:])]
                names = [places[k]["hash"] for k in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["hash", "shingles"]
                )

    sets = documents.select("doc_id", "text", text_hash().alias("text_hash"))
    sets = sets.join(wanted, ["doc_id", "text_hash"]).select("text", "places")
    sets = sets.mapInArrow(run, "hash long, shingles array<long>")
    sets = sets.groupBy("hash").agg(F.first("shingles").alias("shingles"))
    order = ["band", "value"]
    return linked(dealt.join(sets, "hash"), order, "hash", "shingles", lambda s: jaccard_links(s, similarity))


def runs_of_hits(hits: dict[str, np.ndarray], text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of passages found again in which those that hang together follow each other,
    and where in it each run of these begins and ends. ``text`` numbers their texts. Of two
    passages in a text, the one that starts later ends later."""
    start, kept_end = hits["start"], hits["kept_end"]
    far = start - hits["kept_start"]
    order = np.lexsort((start, far, hits["kept_text"], hits["kept_doc_id"], text))
    if not len(order):
        return order, order, order
    # As long in both texts.
    even = hits["end"] - kept_end == far
    a, b = order[:-1], order[1:]
    chained = even[a] & even[b] & (start[b] <= hits["end"][a])
    for same in (text, hits["kept_doc_id"], hits["kept_text"], far):
        chained &= same[a] == same[b]
    first = np.concatenate([[True], ~chained])
    # In one text, the place that stays is not run into: a chain is cut where it would be.
    own = (hits["doc_id"] == hits["kept_doc_id"]) & (hits["text_hash"] == hits["kept_text"])
    begins = np.flatnonzero(first)
    for at, end in zip(begins, np.append(begins[1:], len(order))):
        if end - at > 1 and own[order[at]]:
            stays = kept_end[order[at:end]]
            k = 0
            while (k := max(k + 1, int(np.searchsorted(stays, start[order[at + k]], "right")))) < end - at:
                first[at + k] = True
    heads = np.flatnonzero(first)
    return order, heads, np.append(heads[1:], len(order)) - 1


def joined(rows: DataFrame) -> DataFrame:
    """Passages that overlap in a document and likewise in the one that stays, as one hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy()
            keys = [np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1)]
            fields = lists.flatten()
            columns = dict(zip(HIT, [*keys, *(fields.field(name).to_numpy() for name in HIT[2:])]))
            order, heads, tails = runs_of_hits(columns, np.repeat(np.arange(len(sizes)), sizes))
            ends = {"end", "kept_end"}
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[name][order[tails if name in ends else heads]]) for name in HIT], schema=HIT_SCHEMA
            )

    hits = F.collect_set(F.struct(*HIT[2:])).alias("hits")
    return rows.groupBy("doc_id", "text_hash").agg(hits).mapInArrow(run, ", ".join(f"{c} long" for c in HIT))


def contexts(documents: DataFrame, places: DataFrame, span: int) -> DataFrame:
    """The up to ``span`` words before and after each place, from the place outwards: 32 bits
    of their hashes, and how far each starts from the one after it (before) or ends from the
    one before it (after)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(2).to_pylist()]
            for part in read_together(texts):
                some = batch.slice(part.start, part.stop - part.start)
                words = Words(texts[part])
                hashes = (words.hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
                owner = np.repeat(np.arange(some.num_rows), some.column(3).value_lengths().to_numpy())
                fields = some.column(3).flatten()
                keys = [some.column(k).to_numpy()[owner] for k in (0, 1)]
                spots = [fields.field(name).to_numpy() for name in ("start", "end")]
                start, end = (spot + words.begins[owner] for spot in spots)
                first = np.searchsorted(words.starts, start)
                last = np.searchsorted(words.ends, end, "right")
                before = np.minimum(first - words.firsts[owner], span)
                after = np.minimum(words.firsts[owner] + words.counts[owner] - last, span)
                # The places of the words on one side, one run of indices per place.
                left = np.repeat(first, before) - 1 - counted(before)
                right = np.repeat(last, after) + counted(after)
                # Steps from word to word; the first one from the place itself.
                back = words.starts[np.minimum(left + 1, len(words) - 1)] - words.starts[left]
                ahead = words.ends[right] - words.ends[np.maximum(right - 1, 0)]
                heads = np.cumsum(before) - before
                held = before > 0
                back[heads[held]] = (start - words.starts[np.maximum(first - 1, 0)])[held]
                heads = np.cumsum(after) - after
                held = after > 0
                ahead[heads[held]] = (words.ends[np.minimum(last, len(words) - 1)] - end)[held]
                yield pa.RecordBatch.from_arrays(
                    [
                        *map(pa.array, [*keys, *spots]),
                        *(lists(values, before) for values in (hashes[left], back)),
                        *(lists(values, after) for values in (hashes[right], ahead)),
                    ],
                    schema=CONTEXT_SCHEMA,
                )

    wanted = places.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("places"))
    rows = documents.select("doc_id", text_hash().alias("text_hash"), "text").join(wanted, ["doc_id", "text_hash"])
    # Dealt by the join's keys already: repeated rows go without another shuffle.
    rows = rows.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "places")
    return rows.mapInArrow(run, CONTEXT)


def counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of runs of the sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def extended(documents: DataFrame, rows: DataFrame, span: int) -> DataFrame:
    """Passages joined and grown word by word to both sides, as far as the text is the one
    around the passage that stays. ``span`` words are enough: a run that goes on for more
    holds a further passage both have cut alike."""
    hits = saved(joined(rows), "hits")
    kept = hits.select(*[F.col(k).alias(c) for k, c in zip(("kept_doc_id", "kept_text", "kept_start", "kept_end"), PLACE)])
    around = saved(contexts(documents, hits.select(*PLACE).union(kept), span), "contexts")
    other = [F.col(c).alias(k) for k, c in zip(("kept_doc_id", "kept_text", "kept_start", "kept_end"), PLACE)]
    other = around.select(*other, F.col("before").alias("kept_before"), F.col("after").alias("kept_after"), F.col("back").alias("kept_back"))
    hits = hits.join(around, PLACE).join(other, ["kept_doc_id", "kept_text", "kept_start", "kept_end"])

    def alike(mine: str, theirs: str) -> Column:
        """How many words from the place outwards are the same."""
        equal = F.zip_with(mine, theirs, lambda a, b: F.coalesce(a == b, F.lit(False)))
        first = F.array_position(equal, False)
        return F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int")

    def moved(steps: str, count: str) -> Column:
        """How far the first ``count`` steps lead."""
        return F.aggregate(F.slice(steps, 1, F.col(count)), F.lit(0).cast("long"), lambda total, step: total + step)

    # In one text, a place does not grow into the one that stays.
    one = (F.col("doc_id") == F.col("kept_doc_id")) & (F.col("text_hash") == F.col("kept_text"))
    begin = F.struct(F.lit(0).alias("n"), F.col("start").alias("at"))

    def word(state: Column, size: Column) -> Column:
        # Words only lie further to the left, so once one does not fit none after it does.
        at = state["at"] - size
        return F.struct((state["n"] + (at >= F.col("kept_end")).cast("int")).alias("n"), at.alias("at"))

    room = F.aggregate("back", begin, word, lambda state: state["n"])
    left = F.when(one, F.least(alike("before", "kept_before"), room)).otherwise(alike("before", "kept_before"))
    hits = hits.withColumn("left", left).withColumn("right", alike("after", "kept_after"))
    return hits.select(
        "doc_id",
        (F.col("start") - moved("back", "left")).alias("start"),
        (F.col("end") + moved("ahead", "right")).alias("end"),
        F.lit("passage").alias("kind"),
        "cluster_id",
        "kept_doc_id",
        (F.col("kept_start") - moved("kept_back", "left")).alias("kept_start"),
        "text_hash",
    )


def repeats(
    documents: DataFrame,
    similarity: float = SIMILARITY,
    least_words: int = LEAST_WORDS,
    passage: int = PASSAGE,
    span: int = SPAN,
) -> DataFrame:
    """The places of text that repeats what an earlier document, or an earlier place of the
    same document, already says.

    Two kinds of text are compared. Lines of ``least_words`` words or more are *paragraphs*:
    equal ones are one class, classes that share a MinHash band are compared by their exact
    sets of 5-word shingles, and links of ``similarity`` or more join them in clusters
    (connected components). *Passages* of ``passage`` words start at places the text itself
    decides; equal ones are a cluster, and each grows to both sides as far as the text is that
    around the one that stays. So a run of ``passage + span`` words is found wherever it
    stands, in the middle of a line or over several, from its first word to its last.

    Of each cluster the place with the smallest ``doc_id``, then ``start``, stays. Returns a
    row for every other: ``doc_id``, ``start`` and ``end`` (code points), ``kind``,
    ``cluster_id``, ``kept_doc_id``, ``kept_start`` and the ``text_hash`` of its row. Places may overlap; :func:`cut_out`
    joins them. Words are lower-cased and parted by white space.

    Null and blank texts hold nothing. Rows without a ``doc_id`` take no part. Rows that
    repeat a ``doc_id`` with the same text are one document; with other texts they are
    documents of their own, in the order of ``text_hash``. An empty table gives no rows; other columns are not read.
    """
    found = saved(units(documents, least_words, passage, span), "units")
    place = F.struct("doc_id", "text_hash", "start", "end")
    ends = F.min(place).alias("first"), F.max(place).alias("last")
    alike = found.where("bands is not null").groupBy("hash").agg(*ends, F.first("bands").alias("bands"))
    alike = saved(alike, "classes")
    clusters = components(near_links(documents, alike, similarity))
    alike = alike.join(clusters.withColumnRenamed("node", "hash"), "hash", "left")
    alike = alike.withColumn("cluster_id", F.coalesce("component", "hash"))
    kept = alike.groupBy("cluster_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    kept = kept.where("first <> last").drop("last")
    names = alike.select("hash", "cluster_id").join(kept, "cluster_id")
    lines = found.where("bands is not null").join(names, "hash")

    # Most passages occur once: a count alone, over plain numbers, sets these aside.
    runs = found.where("bands is null").drop("bands")
    # What a join takes from an aggregate of the same rows is written first, so that both
    # sides are plain shuffles and a very common passage is split.
    several = saved(runs.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "several")
    runs = saved(runs.join(sent_if_small(several, F.lit(8)), "hash", "left_semi"), "passages")
    names = saved(runs.groupBy("hash").agg(*ends).where("first <> last"), "kept")
    runs = runs.join(names.select("hash", F.col("hash").alias("cluster_id"), "first"), "hash")

    def others(rows: DataFrame, kind: str, *more: Column) -> DataFrame:
        # A place that overlaps the one that stays, in a text that repeats itself, stays too.
        after = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("text_hash") != F.col("first.text_hash"))
        return rows.where(after | (F.col("start") >= F.col("first.end"))).select(
            "doc_id",
            "start",
            "end",
            F.lit(kind).alias("kind"),
            "cluster_id",
            F.col("first.doc_id").alias("kept_doc_id"),
            F.col("first.start").alias("kept_start"),
            "text_hash",
            *more,
        )

    last = [F.col(f"first.{c}").alias(k) for k, c in (("kept_text", "text_hash"), ("kept_end", "end"))]
    runs = others(runs, "passage", *last).drop("kind").select(*HIT)
    return others(lines, "paragraph").union(extended(documents, runs, span))


def cut_out(documents: DataFrame, places: DataFrame) -> DataFrame:
    """Documents without the text at ``places``; what has no word left goes.

    Overlapping places are cut once. Where text is cut, one line break stays between what
    stood before and after. Documents without such places are returned to the character,
    blank ones among them; so are rows without a ``doc_id``. ``n_chars``, where it is a
    column, is set anew for the cut documents.
    """
    spans = places.groupBy(F.col("doc_id").alias("of"), "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")
    )
    # The row in one column, so that no name of its own clashes with those used here.
    rows = documents.select(F.struct(*documents.columns).alias("row"), text_hash().alias("hash"))
    rows = rows.join(spans, (F.col("row.doc_id") == F.col("of")) & (F.col("hash") == F.col("text_hash")), "left")
    uncut = F.col("spans").isNull()
    text = F.when(uncut, F.col("row.text")).otherwise(without(F.col("row.text"), F.col("spans")))
    rows = rows.withColumn("left", text).where(uncut | F.col("left").rlike(r"\S"))
    columns = []
    for field in documents.schema:
        own = F.col("row").getField(field.name)
        if field.name == "text":
            own = F.col("left")
        elif field.name == "n_chars":
            own = F.when(uncut, own).otherwise(F.length("left").cast(field.dataType))
        columns.append(own.alias(field.name))
    return rows.select(*columns)


def without(text: Column, spans: Column) -> Column:
    """The pieces of ``text`` between sorted ``spans``, trimmed, joined by line breaks."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("kept"))

    def add(state: Column, span: Column) -> Column:
        piece = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(span["start"] > state["at"], F.array_append(state["kept"], piece)).otherwise(state["kept"]).alias("kept"),
        )

    def end(state: Column) -> Column:
        rest = F.substring(text, (state["at"] + 1).cast("int"), F.length(text))
        kept = F.transform(F.array_append(state["kept"], rest), lambda p: F.btrim(p, F.lit(" \t\r\n")))
        return F.array_join(F.filter(kept, lambda p: p != ""), "\n")

    return F.aggregate(spans, start, add, end)
