"""SentencePiece encoding and decoding in vectorised merge rounds (operator 12).

A text becomes words, each a run of blanks and the characters after it, for no piece of the
vocabulary goes on after a blank. The new words of a batch are one flat array of symbols. In
each round the pair of best rank of every word is looked up, its occurrences are merged at
once from the left, and the array is compacted, until no pair is left. The ids of words are
kept between texts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from siltstream.llm.packing import chunks
from siltstream.llm.shared import in_small_batches

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BLANK = "▁"
#: Words of more symbols than this take the best pair of a window, not of the whole word.
LONG = 64
NONE = np.iinfo(np.int32).max


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else number()
        yield tag >> 3, message[at : at + size]
        at += size


class Pieces:
    """A byte-pair vocabulary: which symbols merge, in which order, and what they spell.

    It must fall back to bytes and leave texts as they are, but for blanks and the blank in
    front; other models raise ValueError.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(count)]
        kinds = [
            "byte" if model.is_byte(i) else "other" if model.is_unknown(i) or model.is_control(i) else "piece"
            for i in range(count)
        ]
        spec = dict(fields(dict(fields(model.serialized_model_proto()))[3]))
        # Fields of the normaliser: its table, the blank in front, blanks folded, blanks marked.
        if spec.get(2) or not spec.get(3, 1) or spec.get(4, 1) or not spec.get(5, 1):
            raise ValueError(f"{path} changes texts before it splits them")
        if kinds.count("byte") != 256 or any(model.is_unused(i) for i in range(count)):
            raise ValueError(f"{path} has no bytes to fall back to, or pieces out of use")
        self.ids = {name: i for i, (name, kind) in enumerate(zip(names, kinds)) if kind == "piece"}
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.bytes = np.array([i for i in range(count) if kinds[i] == "byte"], np.int32)
        # Characters inside pieces that are no pieces themselves have numbers of their own.
        self.inner = sorted({c for name in self.ids for c in name}.difference(self.ids))
        symbols = self.ids | {c: count + k for k, c in enumerate(self.inner)}
        self.count = count + len(self.inner)
        self.of_char = np.full(sys.maxunicode + 1, -1, np.int32)
        for name, symbol in symbols.items():
            if len(name) == 1:
                self.of_char[ord(name)] = symbol
        pairs = [
            (symbols[name[:k]] * self.count + symbols[name[k:]], order[model.get_score(i)], i)
            for name, i in self.ids.items()
            for k in range(1, len(name))
            if name[:k] in symbols and name[k:] in symbols
        ]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.rank = np.array([p[1] for p in pairs], np.int32)
        self.made = np.array([p[2] for p in pairs], np.int32)
        # Symbols that take part in a pair no worse than the one they come from: their next
        # merge may come before another occurrence of the same pair.
        own = np.full(self.count, -1, np.int64)
        own[self.made] = self.rank
        self.hasty = np.zeros(self.count, bool)
        for part in (self.keys // self.count, self.keys % self.count):
            self.hasty[part[self.rank <= own[part]]] = True
        self.longest = max(map(len, self.ids), default=1)
        self.spelled(names, kinds)
        self.pattern = re.compile(self.words())

    def words(self) -> str:
        """The pattern of words; long runs of blanks give their first blanks as words."""
        if any(BLANK in name.lstrip(BLANK) for name in self.ids):
            return "(?s).+"
        pattern = f"{BLANK}*[^{BLANK}]+|{BLANK}+"
        blanks = max((len(n) for n in self.ids if not n.strip(BLANK)), default=1)
        mixed = any(name.startswith(2 * BLANK) and name.strip(BLANK) for name in self.ids)
        if blanks > 1 and not mixed and self.alone(blanks * BLANK):
            return f"{BLANK}{{{blanks}}}(?={BLANK})|{pattern}"
        return pattern

    def alone(self, word: str) -> bool:
        """Whether a word becomes one piece."""
        return self.merged([word])[0] == np.int32(self.ids[word]).tobytes()

    def spelled(self, names: list[str], kinds: list[str]) -> None:
        """What each id adds to a decoded text; the unknown id is a mark between blanks."""
        texts = []
        for i, (name, kind) in enumerate(zip(names, kinds)):
            if kind == "byte":
                texts.append(bytes([int(name[3:5], 16)]))
            elif kind == "piece":
                texts.append(name.replace(BLANK, " ").encode())
            else:
                texts.append(" ⁇ ".encode() if i == 0 and name == "<unk>" else b"")
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.is_byte = np.array([kind == "byte" for kind in kinds])
        self.fronted = np.array([kind == "piece" and n.startswith(BLANK) for n, kind in zip(names, kinds)])
        self.silent = self.length == 0

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; no rank if they do not merge."""
        keys = left.astype(np.int64) * self.count + right
        keys[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.rank[at], NONE), self.made[at]

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of each word as 32-bit numbers of this machine."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbol = self.of_char[codes]
        # A character outside the vocabulary keeps its code, below zero.
        symbol = np.where(symbol < 0, -1 - codes, symbol)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            last = np.append(word[1:] != word[:-1], True)
            rank, made = self.pairs(symbol, np.append(symbol[1:], -1))
            rank[last] = NONE
            begins = np.flatnonzero(np.append(True, last[:-1]))
            sizes = np.diff(np.append(begins, len(symbol)))
            best = np.minimum.reduceat(rank, begins)
            ended = best == NONE
            if ended.any():
                over = np.repeat(ended, sizes)
                done.append((word[over], symbol[over]))
                keep = ~over
                symbol, word, rank, made, last = (a[keep] for a in (symbol, word, rank, made, last))
                best, sizes = best[~ended], sizes[~ended]
                if not len(symbol):
                    break
                begins = np.cumsum(sizes) - sizes
            pick = (rank == np.repeat(best, sizes)) & (rank != NONE)
            long = np.repeat(sizes > LONG, sizes)
            hasty = self.hasty[made]
            if long.any():
                pick = np.where(long, self.in_windows(rank, hasty), pick)
            pick = self.from_the_left(pick, hasty & ~long, np.repeat(begins, sizes), rank)
            symbol = np.where(pick, made, symbol)
            stay = np.append(True, ~pick[:-1])
            symbol, word = symbol[stay], word[stay]
        if not done:
            return [b"" for _ in words]
        word = np.concatenate([w for w, _ in done])
        symbol = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        word, symbol = self.in_bytes(word[order], symbol[order])
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        flat = symbol.tobytes()
        return [flat[begin:end] for begin, end in zip([0, *ends], ends)]

    def in_windows(self, rank: np.ndarray, hasty: np.ndarray) -> np.ndarray:
        """Pairs that nothing near can come before: what may take a symbol away reaches no
        farther than the longest piece. Before a pair of a hasty symbol an equal one to its
        left comes first as well."""
        size = self.longest + 1
        padded = np.concatenate([np.full(size, NONE), rank, np.full(size, NONE)]).astype(np.int32)
        width, least = 1, padded
        while 2 * width <= size:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[: len(least) - (size - width)], least[size - width :])
        before, after = least[: len(rank)], least[size + 1 : size + 1 + len(rank)]
        return (rank != NONE) & (rank <= after) & np.where(hasty, rank < before, rank <= before)

    @staticmethod
    def from_the_left(pick: np.ndarray, first_only: np.ndarray, begin: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of pairs that share a symbol the first, third and so on; of hasty ones only the
        first of the word."""
        index = np.arange(len(pick))
        # A chain of pairs of one rank begins where the pair before is another.
        chain = np.append(False, (rank[1:] == rank[:-1]) & (begin[1:] == begin[:-1])) & (rank != NONE)
        starts = np.maximum.accumulate(np.where(chain, 0, index))
        # Only a chain whose first pair may merge is counted off.
        pick = pick & pick[starts] & ((index - starts) % 2 == 0)
        if (pick & first_only).any():
            picked = np.cumsum(pick)
            earlier = picked - pick - (picked - pick)[begin]
            word_hasty = np.zeros(len(pick), bool)
            np.logical_or.at(word_hasty, begin[pick & first_only], True)
            pick = pick & ~(word_hasty[begin] & (earlier > 0))
        return pick

    def in_bytes(self, word: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        strange = (symbol < 0) | (symbol >= len(self.length))
        if not strange.any():
            return word, symbol.astype(np.int32)
        size, spelled = np.ones(len(symbol), np.int64), []
        for k in np.flatnonzero(strange):
            s = int(symbol[k])
            spelled.append((chr(-1 - s) if s < 0 else self.inner[s - len(self.length)]).encode("utf-8"))
            size[k] = len(spelled[-1])
        out = np.repeat(symbol, size).astype(np.int32)
        out[np.repeat(strange, size)] = self.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
        return np.repeat(word, size), out

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of consecutive runs of ``sizes`` ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length)):
            raise ValueError("ids outside the vocabulary")
        length = self.length[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ids) else 0) - np.repeat(ends - length, length)
        spelled = self.flat[np.repeat(self.start[ids], length) + at]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        inner = np.concatenate([[0], ends])
        edges = inner[bounds]
        raw, out = spelled.tobytes(), []
        for k in range(len(sizes)):
            # The blank in front of the first piece that is no control id.
            first = next((i for i in ids[bounds[k] : bounds[k + 1]] if not self.silent[i]), None)
            skip = int(first is not None and self.fronted[first])
            # Bytes on two sides of a control id spell no character together.
            cuts = bounds[k] + np.flatnonzero(self.silent[ids[bounds[k] : bounds[k + 1]]])
            stops = [edges[k], *inner[cuts], edges[k + 1]]
            out.append("".join([readable(raw[a:b]) for a, b in zip(stops, stops[1:])])[skip:])
        return out


def readable(data: bytes) -> str:
    """Text of bytes of which some spell no character: each of those is one U+FFFD."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(data[at : at + error.start].decode())
            out.append("�")
            at += error.start + 1
    return "".join(out)


class Encoder:
    """The ids of texts; those of words are kept between texts, in a bounded store."""

    MOST_WORDS = 300_000
    MOST_SYMBOLS = 4_000_000

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers of this machine."""
        if len(self.known) > self.MOST_WORDS:
            self.known = {}
        find = self.pieces.pattern.findall
        split = [find(BLANK + text.replace(" ", BLANK)) if text else [] for text in texts]
        known = self.known
        new = {word for words in split for word in words if word not in known}
        passing: dict[str, bytes] = {}
        for part in portions(new, self.MOST_SYMBOLS):
            for word, ids in zip(part, self.pieces.merged(part)):
                (known if len(word) <= LONG else passing)[word] = ids
        if passing:
            return [b"".join([known.get(w) or passing[w] for w in words]) for words in split]
        return [b"".join([known[w] for w in words]) for words in split]


def portions(words: set[str], most: int) -> Iterator[list[str]]:
    part, held = [], 0
    for word in words:
        part.append(word)
        held += len(word)
        if held > most:
            yield part
            part, held = [], 0
    if part:
        yield part


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and model."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(documents: DataFrame, model: str = PIECE_BPE) -> DataFrame:
    """Rows ``(doc_id, ids array<int>)``: the piece ids of each whole ``text``, as the
    library that the model was made for gives them, without begin or end ids.

    A null or empty text has no ids. Repeated rows are encoded each for itself, a null
    ``doc_id`` stays null, other columns are not read, an empty table gives no rows. A text
    of any length is one row of one task; a word without blanks of any length is merged in
    windows, in time that grows with its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model)
        for docs, texts in chunks(batches):
            encoded = tool.encode(texts)
            ends = np.cumsum([0, *(len(ids) // 4 for ids in encoded)])
            flat = pa.array(np.frombuffer(b"".join(encoded), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), ids], ["doc_id", "ids"])

    return in_small_batches(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = PIECE_BPE) -> DataFrame:
    """Rows ``(doc_id, ids, text)``: the text that each row's ``ids`` spell.

    Blanks of pieces become spaces, the one in front goes, ids of bytes are put together, and
    bytes that spell no character become U+FFFD. No ids or null ids give an empty text; an id
    outside the vocabulary fails, null ids inside a list are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model).pieces
        for batch in batches:
            lists = batch.column(1)
            # A bounded number of rows at a time keeps the bytes of a batch bounded.
            for at in range(0, batch.num_rows, 256):
                part = lists.slice(at, 256)
                given = [np.zeros(0, np.int32) if x is None else x for x in (held(row) for row in part)]
                sizes = np.array([len(x) for x in given])
                texts = pieces.decoded(np.concatenate(given), sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), part, pa.array(texts, pa.string())], ["doc_id", "ids", "text"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def held(row: pa.ListScalar) -> np.ndarray | None:
    return None if row.values is None else row.values.drop_null().to_numpy(zero_copy_only=False)
