"""Language of texts by rank-order n-gram profiles (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.llm.packing import chunks
from siltstream.llm.words import lacking, lowered

#: N-grams of a document and of a language that are ranked (Cavnar and Trenkle, 1994).
RANKED = 400
#: Letters of the longest n-grams.
LONGEST = 3
#: Labelled documents that teach one language, at most about so many.
MOST_ROWS = 3_000
NO_LANGUAGE = "und"


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to 3 letters of the words of a text, and how often each stands in it.

    Words are runs of letters in lower case, with a blank before and after, which n-grams
    may start or end with but not consist of or run across. An n-gram is a number, made of its
    21-bit code points.
    """
    codes = np.frombuffer(f" {lowered(text)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    gap = lacking(str.isalpha)[codes]
    codes = np.where(gap, 0, codes)
    keep = ~(gap & np.append(gap[1:], False))  # one blank between words
    codes = codes[keep]
    letter = codes > 0
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (codes[:-1] << 21) | codes[1:]
    three = (two[:-1] << 21) | codes[2:]
    found = [codes[letter], two + (1 << 62), three[letter[1:-1]]]
    # A pair has a mark of its own, for a blank has the number 0; a triple with a blank in
    # its midst would run across words.
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(values: np.ndarray, counts: np.ndarray, most: int = RANKED) -> np.ndarray:
    """The most frequent n-grams, first the most frequent, equal ones by number."""
    return values[np.lexsort((values, -counts))[:most]]


class Profiles:
    """Ranks of the n-grams of each language, side by side."""

    def __init__(self, by_language: dict[str, np.ndarray]) -> None:
        self.languages = sorted(by_language)
        self.values = np.unique(np.concatenate([*by_language.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.languages), len(self.values) + 1), -1, np.int64)
        for k, language in enumerate(self.languages):
            profile = by_language[language]
            self.ranks[k, np.searchsorted(self.values, profile)] = np.arange(len(profile))

    def distances(self, profile: np.ndarray) -> np.ndarray:
        """The out-of-place distance to each language: how far apart the ranks of each
        n-gram are, RANKED if the language does not rank it."""
        at = np.searchsorted(self.values, profile)
        known = at < len(self.values)
        known[known] = self.values[at[known]] == profile[known]
        theirs = self.ranks[:, np.where(known, at, len(self.values))]
        apart = np.abs(theirs - np.arange(len(profile)))
        return np.where(theirs < 0, RANKED, np.minimum(apart, RANKED)).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, the first by name on ties, and how much nearer than the
        second it is: 1 if only it ranks the text's n-grams, 0 on a tie."""
        profile = ranked(*grams(text or ""))
        if not len(profile) or not self.languages:
            return NO_LANGUAGE, 0.0
        far = self.distances(profile)
        order = np.argsort(far, kind="stable")
        worst = RANKED * len(profile)
        second = far[order[1]] if len(far) > 1 else worst
        return self.languages[order[0]], float((second - far[order[0]]) / max(1, worst - far[order[0]]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame, most_rows: int = MOST_ROWS) -> Profiles:
    """Profiles of the languages that ``lang`` names, from documents that are not held out.

    Of each language about ``most_rows`` documents are read, chosen by a hash of the id, and
    their n-grams counted in whole texts, per task and then over all tasks. Rows without
    ``lang`` or ``text`` teach nothing; a row without an id is always chosen.
    """
    rows = documents.where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({})
    million = 1_000_000
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1, most_rows / n) * million))])
    chosen = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(million)) < share[F.col("lang")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in chunks(batches):
            for lang in sorted(set(langs)):
                found = [grams(text) for text, other in zip(texts, langs) if other == lang]
                values, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([f[1] for f in found]), len(values)).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(values), pa.string()), "gram": values, "n": counts}
                )

    found = rows.where(chosen).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    found = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The most frequent of each language; ties by number.
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, RANKED)
    rows = found.groupBy("lang").agg(top["gram"].alias("grams")).collect()
    return Profiles({r["lang"]: np.array(r["grams"], np.int64) for r in rows})


def predict(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (0 to 1) of every document.

    The whole ``text`` is ranked and compared; nothing else is read but the id. A null text,
    one without a letter, and every text if no language was learned, is ``und`` with score 0.
    Repeated rows keep a row each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, texts in chunks(batches):
            found = [profiles.predict(text) for text in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(docs, pa.int64()),
                    "lang_pred": pa.array([f[0] for f in found], pa.string()),
                    "score": pa.array([f[1] for f in found], pa.float64()),
                }
            )

    rows = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
