"""Toxicity scores from boosted trees over dense features, calibrated (operator 2)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.llm.packing import chunks
from siltstream.llm.shared import in_small_batches, saved

#: Labelled rows that the model is fitted on, at most about so many.
MOST_ROWS = 20_000
#: Learned lexicon entries, and the G2 statistic each must reach.
MOST_TERMS = 400
LEAST_G2 = 28.0
#: Of a large G2: how often a term must stand in toxic rows, against its share of all rows.
LEAST_LIFT = 3.0
#: Lengths of word beginnings that may become entries, beside whole words.
HEADS = (4, 5, 6)
#: Words between a lexicon word and a second-person word that still count as near.
NEAR = 6
#: Share of the uncalibrated score in the score; it orders rows that calibration ties.
TIE_SHARE = 0.02

# Common insults and second-person words, in natural order.
INSULTS = frozenset(
    "idiot stupid moron loser trash scum clown pathetic worthless disgusting dumb fool ugly jerk"
    " dummkopf trottel abschaum widerlich wertlos erbärmlich"
    " imbécile crétin ordure minable dégoûtant"
    " imbécil estúpido basura patético asqueroso".split()
)
YOU = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer"
    " tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros os".split()
)
# Characters that stand for letters.
STAND_INS = str.maketrans("013457@$!|", "oieastasil", "*.-_'")

WORD = re.compile(r"[^\W\d_]+")
#: Letters with other characters in their midst.
MIXED = re.compile(r"[^\W\d_]+(?:[0-9@$!|*._'-]+[^\W\d_]+)+")
RUN = re.compile(r"(\w)\1\1")

FEATURES = (
    "words chars hits hit_density weight_density most_weight insults near_you you_density nearest"
    " capitals shouted marks questions punctuation symbols digits obfuscated hidden runs".split()
)


def kinds() -> np.ndarray:
    """A kind for each code point below 0x3100; the last entry is for all others."""
    out = np.zeros(0x3101, np.uint8)
    for code in range(0x3100):
        c = chr(code)
        if c.isupper():
            out[code] = 1
        elif c.isalpha():
            out[code] = 2
        elif c.isdigit():
            out[code] = 3
        elif c.isspace():
            out[code] = 4
        elif c in "!¡":
            out[code] = 5
        elif c in "?¿":
            out[code] = 6
        elif c in ".,;:-'\"()":
            out[code] = 7
        else:
            out[code] = 8
    out[0x3100] = 2
    return out


KINDS = kinds()


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, which end in a dash."""
    return [word, *(word[:n] + "-" for n in HEADS if len(word) > n)]


@dataclass
class Lexicon:
    """Learned terms with their weights."""

    terms: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        least = min(HEADS)
        self.heads = {term.rstrip("-")[:least] for term in [*self.terms, *INSULTS]}
        self.least = least

    def weight(self, word: str) -> float:
        return max((self.terms.get(term, 0.0) for term in terms_of(word)), default=0.0)

    def features(self, text: str) -> list[float]:
        """One number for each of FEATURES; an empty text gives zeros."""
        low = text.lower()
        words = WORD.findall(low)
        n, heads, least = len(words), self.heads, self.least
        found = [i for i, word in enumerate(words) if word[:least] in heads]
        weights = {i: w for i in found if (w := self.weight(words[i]))}
        insults = sum(words[i] in INSULTS for i in found)
        you = np.array([i for i, word in enumerate(words) if word in YOU], np.int64)
        gaps = [int(np.abs(you - i).min()) for i in weights] if len(you) else []
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = np.bincount(KINDS[np.minimum(codes, 0x3100)], minlength=9)
        letters, chars = max(1, kind[1] + kind[2]), max(1, len(text))
        odd = MIXED.findall(low)
        hidden = sum(self.weight(w := o.translate(STAND_INS)) > 0 or w in INSULTS for o in odd)
        shouted = sum(a.isupper() and len(a) > 2 for a in text.split()) if kind[1] > 2 else 0
        return [
            math.log1p(n),
            math.log1p(len(text)),
            math.log1p(len(weights)),
            len(weights) / max(1, n),
            sum(weights.values()) / max(1, n),
            max(weights.values(), default=0.0),
            math.log1p(insults),
            sum(gap <= NEAR for gap in gaps) / max(1, len(weights)),
            len(you) / max(1, n),
            1 / (1 + min(gaps)) if gaps else 0.0,
            kind[1] / letters,
            shouted / max(1, n),
            kind[5] / chars,
            kind[6] / chars,
            kind[7] / chars,
            kind[8] / chars,
            kind[3] / chars,
            len(odd) / max(1, n),
            math.log1p(hidden),
            len(RUN.findall(low)) / max(1, n),
        ]

    def column(self, text: Column) -> Column:
        """The features of a text column; a null text is empty."""

        @F.pandas_udf("array<double>")
        def features(texts: pd.Series) -> pd.Series:
            return pd.Series([self.features(text or "") for text in texts])

        return features(text)


@dataclass
class Model:
    """A fitted scorer; without trees it gives every text the ``share`` of toxic rows."""

    lexicon: Lexicon
    share: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def raw(self, rows: DataFrame) -> DataFrame:
        """Adds the uncalibrated score ``_raw`` of the column ``_vector``."""
        return self.trees.transform(rows).withColumn("_raw", vector_to_array("_probability")[1])

    def scored(self, documents: DataFrame) -> DataFrame:
        """Each row as the struct ``_row``, with its ``score``."""
        rows = in_small_batches(documents).select(F.struct("*").alias("_row"))
        if self.trees is None:
            return rows.withColumn("score", F.lit(float(self.share)))
        rows = self.raw(rows.withColumn("_vector", array_to_vector(self.lexicon.column(F.col("_row.text")))))
        rows = self.calibration.transform(rows) if self.calibration else rows.withColumn("_even", F.col("_raw"))
        score = (1 - TIE_SHARE) * F.col("_even") + TIE_SHARE * F.col("_raw")
        return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))

    def score(self, documents: DataFrame) -> DataFrame:
        """Documents with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of ``text``.

        Columns of these names that the documents have are replaced; all others are kept, and
        none but ``text`` is read. Null and empty texts are scored like any other. Repeated
        rows get the same score. An empty table stays empty.
        """
        kept = [F.col("_row").getField(c).alias(c) for c in documents.columns if c not in ("score", "predicted")]
        rows = self.scored(documents)
        return rows.select(*kept, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

    def accepted(self, documents: DataFrame) -> DataFrame:
        """The documents, with all their columns, that score below 0.5."""
        return self.scored(documents).where("score < 0.5").select("_row.*")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """Texts with their label and a number 0 to 3 that says which part they are in.

    Rows are chosen by a hash of the id, about ``most_rows`` of them, so that the broadcast
    of their ids is bounded by that parameter. Contradicting labels of an id or of a whole
    text count as toxic; equal whole texts are one row, the one of the smallest id, for
    copies would count many times.
    """
    labels = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    share = min(1.0, most_rows / max(1, labels.count()))
    million = 1_000_000
    chosen = labels.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(million)) < share * million)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", "toxic")
    rows = rows.groupBy(F.sha2("text", 256).alias("hash")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")
    )
    part = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(4))
    return saved(rows.select("text", "toxic", part.alias("part")), "labelled")


def learn_lexicon(rows: DataFrame, most_terms: int = MOST_TERMS) -> Lexicon:
    """Words and word beginnings that mark toxic rows, by the G2 statistic of the rows
    that have them. Counts are added up per task, then per term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for toxic, texts in chunks(batches):
            for label, text in zip(toxic, texts):
                words = set(WORD.findall(text.lower()))
                counts[int(label)].update({term for word in words for term in terms_of(word)})
        names = list(counts[1])  # a term of no toxic row cannot mark one
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array(names, pa.string()),
                "bad": pa.array([counts[1][t] for t in names], pa.int64()),
                "good": pa.array([counts[0][t] for t in names], pa.int64()),
            }
        )
        names = [t for t in counts[0] if t not in counts[1]]
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array(names, pa.string()),
                "bad": pa.array([0] * len(names), pa.int64()),
                "good": pa.array([counts[0][t] for t in names], pa.int64()),
            }
        )

    totals = {bool(row["toxic"]): row["count"] for row in rows.groupBy("toxic").count().collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    if not bad or not good:
        return Lexicon()
    base = bad / (bad + good)
    found = in_small_batches(rows).select("toxic", "text").mapInArrow(count, "term string, bad long, good long")
    found = found.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    none = F.when(F.col("good") > 0, F.col("good") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    found = found.withColumn("g2", 2 * (F.col("bad") * F.log(share / base) + none))
    found = found.where((F.col("bad") > 0) & (share > LEAST_LIFT * base) & (F.col("g2") >= LEAST_G2))
    chosen = found.orderBy(F.desc("g2"), "term").limit(most_terms).collect()
    odds = math.log((bad + 1) / (good + 1))
    return Lexicon({r["term"]: math.log((r["bad"] + 0.5) / (r["good"] + 0.5)) - odds for r in chosen})


def learn(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, trees: int = 30) -> Model:
    """Fits lexicon, boosted trees and isotonic calibration on labelled documents.

    Only rows of ``labels`` whose crc32(doc_id as text) mod 5 is not 0 are read, and of these
    a bounded sample of about ``most_rows``. Three quarters teach the lexicon and the trees,
    the rest calibrates. ``lang``, ``source`` and ``doc_id`` are not inputs. Labels that are
    null or not 0 or 1 are ignored. Without rows of both classes, every score is the share of
    toxic rows.
    """
    rows = training_rows(documents, labels, most_rows)
    parts = rows.groupBy("part", "toxic").count().collect()
    bad = sum(r["count"] for r in parts if r["toxic"])
    share = bad / max(1, sum(r["count"] for r in parts))
    taught = {bool(r["toxic"]) for r in parts if r["part"]}
    if len(taught) < 2:
        return Model(Lexicon(), share)
    lexicon = learn_lexicon(rows.where("part <> 0"))
    rows = rows.select("part", "toxic", array_to_vector(lexicon.column(F.col("text"))).alias("_vector"))
    rows = saved(rows, "features")
    booster = GBTClassifier(
        featuresCol="_vector",
        labelCol="toxic",
        predictionCol="_prediction",
        maxIter=trees,
        maxDepth=4,
        stepSize=0.2,
        minInstancesPerNode=5,
        seed=1,
    )
    booster = booster.setProbabilityCol("_probability").setRawPredictionCol("_margin")
    # A bounded number of short rows: more tasks would only cost their start.
    model = Model(lexicon, share, booster.fit(rows.where("part <> 0").coalesce(4)))
    if {bool(r["toxic"]) for r in parts if not r["part"]} == {True, False}:
        calibrate = IsotonicRegression(featuresCol="_raw", labelCol="toxic", predictionCol="_even")
        model.calibration = calibrate.fit(model.raw(rows.where("part = 0")))
    return model
