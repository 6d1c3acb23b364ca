"""Periodic runs of words by branching tandem repeats in a suffix array (operator 13).

After Stoye and Gusfield: a square ``uu`` whose next word differs is *branching*: its two
suffixes ``i`` and ``i + |u|`` lie in different children of the LCP interval of depth
``|u|``. For each interval the suffixes of all children but the largest are tested by
``ISA[i +- depth]``. A branching square is the last one of its run; rotating it to the left
gives the run's start. Intervals are pairs of bounds in arrays; no tree is built. All
documents of a batch share one suffix array, each with words of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstream.llm.packing import chunks
from siltstream.llm.shared import in_small_batches

#: Words of a run, at least; it also has two periods.
SHORTEST = 12
#: Pairs of suffix and depth that are tested at a time.
MOST_PAIRS = 1 << 21


class Suffixes:
    """The enhanced suffix array of a sequence of numbers, by prefix doubling.

    ``levels[k]`` ranks the suffixes by their first ``2**k`` words; equal ranks are equal
    words. Only suffixes whose rank is shared are sorted again.
    """

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.order = np.argsort(words, kind="stable")
        ordered = words[self.order]
        rank = self.ranked(np.append(True, ordered[1:] != ordered[:-1]) if n else np.zeros(0, bool))
        self.levels = [rank]
        size = 1
        while True:
            place = rank[self.order]
            equal = place[1:] == place[:-1]
            slots = np.flatnonzero(np.append(equal, False) | np.append(False, equal)) if n else []
            if not len(slots):
                break
            rows = self.order[slots]
            after = rows + size
            second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
            key = rank[rows].astype(np.int64) * (n + 1) + second + 1
            turn = np.argsort(key, kind="stable")
            self.order[slots] = rows[turn]
            key = key[turn]
            new = np.ones(n, bool)
            new[slots] = np.append(True, key[1:] != key[:-1])
            rank = self.ranked(new)
            self.levels.append(rank)
            size *= 2
        self.place = rank

    def ranked(self, begins: np.ndarray) -> np.ndarray:
        """Ranks from where in the order a new group of equal suffixes begins."""
        rank = np.empty(len(self.order), np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes ``a`` and ``b`` begin with in common."""
        n, a, b = len(self.order), a.copy(), b.copy()
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = inside & (self.levels[k][np.minimum(a, n - 1)] == self.levels[k][np.minimum(b, n - 1)])
            step = same.astype(np.int64) << k
            a, b, length = a + step, b + step, length + step
        return length

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before the places ``a`` < ``b`` are equal."""
        a, b = a.copy(), b.copy()
        length = np.zeros(len(a), np.int64)
        k = len(self.levels) - 1
        largest = True
        while k >= 0:
            level, size = self.levels[k], 1 << k
            same = (a >= size) & (level[np.maximum(a - size, 0)] == level[np.maximum(b - size, 0)])
            step = same.astype(np.int64) << k
            a, b, length = a - step, b - step, length + step
            # Blocks of the largest size may repeat, those of the others only once after them.
            largest &= bool(same.any())
            k -= not largest
        return length


def nearest_below(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last places before the places ``at`` with a value not above theirs, and with one
    below it. The values at ``at`` are above 0, and the first value is not.

    ``least[k]`` holds the minima of the ``2**k`` values up to each place; blocks of falling
    size are stepped over while all of their values are larger."""
    walls = np.flatnonzero(values <= 0)
    widest = int(np.diff(np.append(walls, len(values))).max())
    least = [values]
    while 2 << len(least) <= 2 * widest:
        size = 1 << (len(least) - 1)
        least.append(np.concatenate([np.minimum(least[-1][:size], values[0]), np.minimum(least[-1][size:], least[-1][:-size])]))
    found = []
    for allowed in (values[at], values[at] - 1):
        place = at - 1
        for k in range(len(least) - 1, -1, -1):
            # A block that passes the first value holds it, and so is not stepped over.
            place = place - ((least[k][place] > allowed).astype(np.int64) << k)
        found.append(place)
    return found[0], found[1]


def squares(suffixes: Suffixes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of every branching square."""
    order, place, n = suffixes.order, suffixes.place, len(words)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # lcp[k] of the suffixes k - 1 and k of the order; a bound of -1 on both sides.
    lcp = np.concatenate([[-1], suffixes.common(order[:-1], order[1:]), [-1]]).astype(np.int32)
    # At each bound k of an interval lies the child before it; after the last bound of an
    # interval also the child behind it.
    k = np.flatnonzero(lcp > 0)
    if not len(k):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, low = nearest_below(lcp, k)
    after, high = (n - place[::-1] for place in nearest_below(lcp[::-1], n - k[::-1]))
    last = after == high
    first = np.concatenate([before, k[last]])
    end = np.concatenate([k, after[last]])
    depth, left, right = (np.concatenate([a, a[last]]) for a in (lcp[k], low, high))
    # All children of an interval but its largest, the first of them on ties.
    size = end - first
    turn = np.lexsort((first, -size, left, depth))
    same = np.append(False, (depth[turn][1:] == depth[turn][:-1]) & (left[turn][1:] == left[turn][:-1]))
    chosen = turn[same]
    first, size, depth, left, right = (a[chosen] for a in (first, size, depth, left, right))
    starts, halves = [], []
    for part in portions(size):
        count = size[part]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        i = order[np.repeat(first[part], count) + at].astype(np.int64)
        d, l, r = (np.repeat(a[part], count) for a in (depth, left, right))
        for j in (i, i - d):
            # The square of j and j + d; its other suffix lies in the interval as well.
            other = i + d if j is i else j
            inside = (other >= 0) & (other < n)
            spot = place[np.where(inside, other, 0)]
            good = inside & (spot >= l) & (spot < r)
            # In another child: the words after the two suffixes' common ones differ.
            next_ = j + 2 * d
            good &= (next_ >= n) | (words[np.where(good, j + d, 0)] != words[np.where(good & (next_ < n), next_, 0)])
            starts.append(j[good])
            halves.append(d[good])
    return np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*halves, np.zeros(0, np.int64)])


def portions(sizes: np.ndarray) -> Iterator[slice]:
    """Slices whose sizes add up to about MOST_PAIRS."""
    if not len(sizes):
        return
    block = np.cumsum(sizes) // MOST_PAIRS
    edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(sizes)]])
    for a, b in zip(edges, edges[1:]):
        yield slice(a, b)


def runs(words: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of a sequence of numbers, by start and period."""
    suffixes = Suffixes(words)
    start, period = squares(suffixes, words)
    end = start + 2 * period
    # Rotate to the left: words a period apart that are equal.
    start = start - suffixes.common_before(start, start + period)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # One stretch may be found with multiples of its period and from both suffixes.
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, bool)
    keep = new & (end - start >= shortest)
    start, length, period = start[keep], (end - start)[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word; no word of two texts has the same."""
    known = {word: i for i, word in enumerate(set(chain.from_iterable(texts)))}
    flat = np.array(list(map(known.__getitem__, chain.from_iterable(texts))), np.int64)
    return flat * (len(texts) + 1) + np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def found(texts: list[str], shortest: int) -> Iterator[tuple[list, str]]:
    """The runs of each text as (start, length, period), and its words without repeats."""
    # Words of bytes are parted by the space and by the codes 9 to 13.
    words = [text.encode().split() for text in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    start, length, period = runs(numbered(words), shortest)
    edges = np.cumsum(sizes) - sizes
    # Only documents with words hold a run; empty ones share their edge with the next.
    doc = np.searchsorted(edges, start, "right") - 1
    begin = np.concatenate([np.searchsorted(doc, np.arange(len(texts))), [len(doc)]])
    for k, said in enumerate(words):
        mine = slice(begin[k], begin[k + 1])
        at, size, step = start[mine] - edges[k], length[mine], period[mine]
        if len(at):
            change = np.zeros(len(said) + 1, np.int64)
            np.add.at(change, at + step, 1)
            np.add.at(change, at + size, -1)
            said = [said[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        found_ = [{"start": s, "length": n, "period": p} for s, n, p in zip(at.tolist(), size.tolist(), step.tolist())]
        yield found_, b" ".join(said).decode()


def periodic_runs(documents: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Rows ``(doc_id, runs, collapsed)`` of each whole ``text``.

    Words are what spaces and the control characters 9 to 13 part. A run is a longest stretch
    of words with its smallest period ``q`` that has at least ``shortest`` words and two
    periods; ``runs`` lists ``(start, length, period)`` by start, then period. ``collapsed``
    has the text's words, joined by one space, without those that a run holds after its first
    period.

    A null or empty text has no runs and an empty ``collapsed``. Repeated rows are answered
    each for itself, a null ``doc_id`` stays null, other columns are not read, an empty table
    gives no rows. A text of any length is one row of one task, in memory of about 100 bytes
    for each word and each doubling of its longest repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, texts in chunks(batches, 1 << 20):
            answers = list(found(texts, shortest))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64()),
                    pa.array([a for a, _ in answers], RUNS),
                    pa.array([c for _, c in answers], pa.string()),
                ],
                ["doc_id", "runs", "collapsed"],
            )

    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return in_small_batches(documents.select("doc_id", "text")).mapInArrow(run, schema)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
