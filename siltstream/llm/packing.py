"""Packing documents into training sequences by the sum-of-squares rule (operator 3).

Online packing after Csirik et al.: each item goes to the fill level that minimises the sum
of the squared numbers of partially filled windows, one number per level. Every task packs
the documents of its own partition as they come, so nothing is shuffled.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from siltstream.llm.shared import in_small_batches

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LENGTH = 2048
#: Open windows of a task, of at most LENGTH ids each, before they are laid out anew.
MOST_OPEN = 2048


class WordIds:
    """Token ids of texts, with the ids of words kept between texts.

    The vocabulary splits a text at white space, then into runs of letters, single numerals
    and runs of other characters, and no token spans two of them. So a word's ids are the
    same wherever it stands. Texts outside Latin letters, where lower-casing or white space
    could be understood differently, go through the tokenizer as a whole; so does everything
    if the file's rules are not the ones assumed here.
    """

    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ]")
    #: Words that a store holds before a new one is begun; the one before is kept as well.
    MOST_WORDS = 500_000
    #: Parts that go through the tokenizer as one text.
    AT_ONCE = 200

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        rules = json.loads(self.whole.to_str())
        self.by_word = self.splits_words(rules)
        # The named call knows the special tokens by their strings, which no word may split.
        strings = [re.escape(token["content"]) for token in rules["added_tokens"]]
        self.special = re.compile("|".join(strings)) if strings else None
        self.part = Tokenizer.from_file(path)
        self.part.encode_special_tokens = True
        self.part.normalizer = None
        self.part.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # The last token of each part, and no other, bears the mark of a word's end.
        suffix = rules["model"].get("end_of_word_suffix") or ""
        self.by_word &= bool(suffix)
        ids = self.whole.get_vocab()
        self.final = np.zeros(max(ids.values()) + 1, bool)
        self.final[[i for token, i in ids.items() if token.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def splits_words(self, rules: dict) -> bool:
        """Whether the file normalises and splits as PARTS does."""
        steps = [step["type"] for step in (rules["normalizer"] or {}).get("normalizers", [])]
        splits = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        pattern = splits[0].get("pattern", {}).get("Regex")
        return steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 2 and pattern == self.PARTS.pattern

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out: list = [None] * len(texts)
        gaps: dict[int, tuple[list, list]] = {}
        missing: set[str] = set()
        for k, text in enumerate(texts):
            plain = self.by_word and not self.OTHER.search(text) and unicodedata.is_normalized("NFC", text)
            if not plain or (self.special and self.special.search(text)):
                out[k] = packed_ids(self.whole.encode(text, add_special_tokens=False).ids)
                continue
            words = text.lower().split()
            found = list(map(self.words.get, words))
            if None in found:
                places = [(i, words[i]) for i, ids in enumerate(found) if ids is None]
                missing.update(word for _, word in places)
                gaps[k] = (found, places)
            else:
                out[k] = b"".join(found)
        if missing:
            new = self.learn(missing)
            for k, (found, places) in gaps.items():
                for i, word in places:
                    found[i] = new[word]
                out[k] = b"".join(found)
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not at hand: from those set aside last, or from their parts."""
        if len(self.words) > self.MOST_WORDS:
            self.words, self.older_words = {}, self.words
        if len(self.parts) > self.MOST_WORDS:
            self.parts = {}
        older, parts = self.older_words, self.parts
        known = {word: older[word] for word in words if word in older}
        split = {word: self.split(word) for word in words if word not in known}
        self.encode_parts(list(set(chain.from_iterable(split.values())).difference(parts)))
        for word, pieces in split.items():
            known[word] = parts[pieces[0]] if len(pieces) == 1 else b"".join([parts[piece] for piece in pieces])
        self.words.update(known)
        return known

    def encode_parts(self, parts: list[str]) -> None:
        """Puts the ids of parts, many of them read as one text, into their store."""
        if not parts:
            return
        texts = [" ".join(parts[k : k + self.AT_ONCE]) for k in range(0, len(parts), self.AT_ONCE)]
        ids = [found.ids for found in self.part.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), "<u4")
        ends = (4 * np.flatnonzero(self.final[flat]) + 4).tolist()
        raw = flat.tobytes()
        self.parts.update((part, raw[a:b]) for part, a, b in zip(parts, [0, *ends[:-1]], ends, strict=True))

    def split(self, word: str) -> list[str]:
        """The parts of a word; letters, and letters before a single mark, are plain."""
        if word.isalpha():
            return [word]
        if word[-1] in ".,;:?!" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.PARTS.findall(word)


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process and tokenizer. Threads of its own would only compete with
    the other tasks of the executor."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


class Levels:
    """Open windows by fill level, and the array of their numbers."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.count = np.zeros(length + 1, np.int64)
        self.windows: dict[int, list[list]] = {}
        self.open = 0

    def place(self, piece: tuple, size: int) -> list | None:
        """Puts a piece where the sum of squares grows least, the fullest window on ties;
        returns the window if that fills it."""
        count, room = self.count, self.length - size
        levels = np.flatnonzero(count[: room + 1])
        best, level = 2 * int(count[size]) + 1, 0
        if len(levels):
            after = np.where(levels < room, 2 * count[levels + size] + 1, 0)
            # Moving a window up from a level next to its own kind changes both terms.
            cost = after - 2 * count[levels] + 1
            k = len(cost) - 1 - int(cost[::-1].argmin())
            if cost[k] <= best:
                level = int(levels[k])
        if level:
            window = self.windows[level].pop()
            count[level] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        level += size
        if level == self.length:
            return window
        self.windows.setdefault(level, []).append(window)
        count[level] += 1
        self.open += 1
        return None

    def take(self) -> list:
        """The pieces of all open windows, fullest first; none is open afterwards."""
        pieces = [p for level in sorted(self.windows, reverse=True) for w in self.windows[level] for p in w]
        self.count[:], self.windows, self.open = 0, {}, 0
        return pieces


def laid_out(pieces: list[tuple], length: int) -> Iterator[list[tuple]]:
    """Pieces ``(document, start, ids, tokens)`` one after another in windows of ``length``,
    cut where a window ends; the last may be shorter."""
    window, room = [], length
    for doc, start, ids, tokens in pieces:
        size, at = len(ids) // 4, 0
        while at < size:
            take = min(room, size - at)
            window.append((doc, start + at, ids[4 * at : 4 * (at + take)], tokens))
            at, room = at + take, room - take
            if not room:
                yield window
                window, room = [], length
    if window:
        yield window


def by_powers(window: list[tuple], length: int) -> Iterator[list[tuple]]:
    """A last window that is not full, cut into sequences of powers of two, which need no
    padding."""
    left = sum(len(p[2]) // 4 for p in window)
    while left:
        size = 1 << (left.bit_length() - 1)
        first, *rest = laid_out(window, size)
        yield first
        window, left = [p for w in rest for p in w], left - size


def pack(
    documents: DataFrame,
    length: int = LENGTH,
    tokenizer: str = WORD_BPE,
    end_id: int = 1,
    most_open: int = MOST_OPEN,
) -> DataFrame:
    """Packs the ids of ``text`` and ``end_id`` of all documents into windows of ``length``.

    Returns a row per piece: ``doc_id``, ``start`` (ids of the document before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and
    ``offset`` in the sequence.

    A document's full windows are sequences of their own; what is left over goes to the level
    that the sum of squares asks for. Over ``most_open`` open windows, and at the end of a
    task, the open windows are laid out one after another and cut where one is full, so a
    task holds a bounded number of windows and pads none; the last ids of a task become
    sequences of powers of two.

    A null or empty text is one id long. Repeated rows are packed each for itself, a null
    ``doc_id`` stays null, other columns are not read, an empty table gives no rows.
    """
    order = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, levels = word_ids(tokenizer), Levels(length)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0

        def close(window: list[tuple]) -> None:
            nonlocal sequence, held
            offset = 0
            for doc, start, ids, tokens in window:
                size = len(ids) // 4
                rows.append((doc, start, size, ids, tokens, sequence, offset))
                offset, held = offset + size, held + len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            nonlocal rows, held
            columns = list(zip(*rows)) or [[]] * len(order)
            rows, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, order)], schema=order)

        end = packed_ids([end_id])
        for docs, texts in chunks(batches):
            for doc, ids in zip(docs, encoder.encode(texts)):
                ids += end
                tokens = len(ids) // 4
                full = tokens - tokens % length
                for at in range(0, full, length):
                    close([(doc, at, ids[4 * at : 4 * (at + length)], tokens)])
                if full < tokens:
                    window = levels.place((doc, full, ids[4 * full :], tokens), tokens - full)
                    if window:
                        close(window)
                if levels.open > most_open:
                    for window in laid_out(levels.take(), length):
                        size = sum(len(p[2]) // 4 for p in window)
                        if size == length:
                            close(window)
                        else:
                            levels.windows[size] = [window]
                            levels.count[size] = levels.open = 1
                if held > 4 << 20:
                    yield flush()
        for window in laid_out(levels.take(), length):
            if sum(len(p[2]) // 4 for p in window) == length:
                close(window)
            else:
                for part in by_powers(window, length):
                    close(part)
            if held > 4 << 20:
                yield flush()
        yield flush()

    return in_small_batches(documents.select("doc_id", "text")).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def chunks(batches: Iterator[pa.RecordBatch], most_chars: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the first two columns, a few million characters at a time; null
    texts are empty."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            ids.append(key)
            texts.append(text)
            held += len(text)
            if held > most_chars:
                yield ids, texts
                ids, texts, held = [], [], 0
        # What a batch took goes back, for other workers of the executor need it.
        pa.default_memory_pool().release_unused()
    if ids:
        yield ids, texts
