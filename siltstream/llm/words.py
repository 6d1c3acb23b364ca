"""Words of a text as arrays: hashes and places, without a Python object per word."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

#: Code points with an entry among white space, which has no later ones.
TABLED = 0x3100


def mixed(values: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def random_odd(count: int, seed: int) -> np.ndarray:
    steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(steps + np.uint64(seed)) | np.uint64(1)


def gaps(is_gap) -> np.ndarray:
    return np.array([is_gap(chr(c)) for c in range(TABLED)] + [False])


SPACES = gaps(str.isspace)
PLACE = random_odd(64, 1)
BASE = 0x9E3779B97F4A7C15


@cache
def lacking(kind: Callable[[str], bool]) -> np.ndarray:
    """Which of all code points are not of a kind, such as str.isalnum."""
    count = sys.maxunicode + 1
    return ~np.fromiter(map(kind, map(chr, range(count))), bool, count)


def lowered(text: str) -> str:
    """Lower case of the same length, so that places stay those of the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


class Words:
    """Hashes of the lower-cased words of a text, and where they start and end in it.

    Words are what white space parts, or runs of letters and digits if ``letters`` is set.
    Several texts are read in one go, with a line break after each: ``begins`` has the place
    where each one starts, ``firsts`` and ``counts`` its first word and number of words.
    """

    def __init__(self, text: str | list[str], letters: bool = False) -> None:
        # Each in lower case by itself, for that of a letter may hang on those around it.
        texts = [lowered(part) for part in ([text] if isinstance(text, str) else text)]
        self.codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        gap = lacking(str.isalnum)[self.codes] if letters else SPACES.take(self.codes, mode="clip")
        edges = np.flatnonzero(np.concatenate([[True], gap]) != np.concatenate([gap, [True]]))
        self.starts, self.ends = edges[::2], edges[1::2]
        sizes = np.array([len(part) + 1 for part in texts], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        self.firsts = np.searchsorted(self.starts, self.begins)
        self.counts = np.diff(np.append(self.firsts, len(self.starts)))
        if not len(edges):
            self.hashes = np.zeros(0, np.uint64)
            return
        first, last = edges[0], edges[-1]
        place = np.arange(first, last)
        place -= np.repeat(self.starts, np.diff(np.append(self.starts, last)))
        values = self.codes[first:last].astype(np.uint64) * PLACE[place & 63]
        # Sums of the words and of the gaps between them in turn.
        self.hashes = mixed(np.add.reduceat(values, edges[:-1] - first)[::2])

    def __len__(self) -> int:
        return len(self.starts)


#: Characters of short texts that are read in one go: their arrays stay in a core's cache.
READ_CHARS = 1 << 16


def read_together(texts: list[str], most_chars: int = READ_CHARS) -> Iterator[slice]:
    """Cuts a list of texts where about ``most_chars`` are reached; a long text goes alone or
    with the short ones before it."""
    begin = held = 0
    for k, text in enumerate(texts):
        held += len(text) + 1
        if held >= most_chars:
            yield slice(begin, k + 1)
            begin, held = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def grams(hashes: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """Rolling polynomial (Karp-Rabin) hashes of every ``size`` consecutive words, or of those
    that start ``at`` some words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    # Hashes of 1, 2, 4, ... words; the binary digits of the size put them together.
    out, done, step, power = None, 0, hashes, 1
    base = BASE
    while power <= size:
        if size & power:
            part = step[done : done + count]
            out = part if out is None else out * np.uint64(base) + part
            done += power
        if 2 * power <= size:
            step = step[:-power] * np.uint64(base) + step[power:]
        base, power = base * base % (1 << 64), 2 * power
    return mixed(out if at is None else out[at])
