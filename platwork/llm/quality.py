"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Method: P(grade >= k) = logistic(score - threshold_k) with ordered thresholds and one weight vector
for all of them. The score is the sum of the weights of a document's features: its distinct words
in lower case and their beginnings, hashed, and the hashed levels of four whole-text shares (words in capitals, words
that end in several marks, words without letters, distinct words). Features are made where the text lies; only
the weights, of fixed size, travel. Fitting takes a bounded sample of the labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.llm.common import raw_bytes, table

#: Labelled rows that the model is fitted on, at most: those with the smallest hashed ids.
MAX_LABELLED = 8192
BITS = 18
GRADES = 3  # 0 toxic, 1 poor, 2 good
KEEP_FROM = 2
MIN_PROBABILITY = 0.5
# Words remembered per Python worker before it starts anew.
KNOWN_WORDS = 200_000
_MASK = (1 << BITS) - 1
_CAPS, _MARKS, _BARE = 1 << 60, 1 << 59, 1 << 58
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_LEVELS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85])
_SHARES = np.array([[zlib.crc32(b"share %d %d" % (i, k)) & _MASK for k in range(len(_LEVELS) + 1)] for i in range(4)])


class OrdinalModel(NamedTuple):
    weights: np.ndarray  # 2 ** BITS of float32
    thresholds: np.ndarray  # GRADES - 1 in ascending order

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1, one column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


class Features(dict):
    """Word -> three buckets and marks of its shape, in one number.

    The buckets are those of the word, of its first four letters, and of its first five letters or,
    where it ends in several punctuation marks, of these.
    """

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        plain = text.strip(_PUNCTUATION)
        low = plain.lower() or text
        code = 0
        tail = text[len(text.rstrip(_PUNCTUATION)) :]
        last = "m" + tail[-3:] if plain and len(tail) > 1 else "5" + low[:5] if len(low) > 5 else low
        for k, part in enumerate((low, "4" + low[:4] if len(low) > 4 else low, last)):
            code |= (zlib.crc32(part.encode()) & _MASK) << (BITS * k)
        if len(plain) > 1 and plain.isupper():
            code |= _CAPS
        if plain and len(tail) > 1:
            code |= _MARKS
        if not any(c.isalpha() for c in text):
            code |= _BARE
        self[word] = code
        return code

    def of(self, text: bytes) -> np.ndarray:
        """Sorted buckets of a whole text; empty for a text without words."""
        words = text.split()
        if not words:
            return np.empty(0, np.int64)
        distinct = set(words)
        codes = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))
        n = len(codes)
        shares = [np.count_nonzero(codes & m) / n for m in (_CAPS, _MARKS, _BARE)]
        shares.append(n / len(words) if len(words) >= 20 else 1.0)
        levels = [_SHARES[i][: k + 1] for i, k in enumerate(np.searchsorted(_LEVELS, shares, "right").tolist())]
        return np.unique(np.concatenate([codes & _MASK, codes >> BITS & _MASK, codes >> 2 * BITS & _MASK, *levels]))


def _telling(rows: list[np.ndarray], grades: np.ndarray, least: int = 4, deviations: float = 5.0) -> np.ndarray:
    """Buckets in at least ``least`` rows whose share of some grade is far from that grade's share of all rows."""
    out = np.zeros(1 << BITS, bool)
    if not len(rows):
        return out
    seen = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    for grade in range(GRADES):
        own, share = [r for r, g in zip(rows, grades) if g == grade], np.mean(grades == grade)
        if 0 < share < 1:
            count = np.bincount(np.concatenate(own), minlength=1 << BITS)
            out |= np.abs(count - seen * share) > deviations * np.sqrt(seen * share * (1 - share))
    return out & (seen >= least)


def fit(rows: list[np.ndarray], grades: np.ndarray, epochs: int = 20, rate: float = 0.08, shrink: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood by AdaGrad over batches in a fixed order; buckets that tell no grade keep weight zero.

    Without telling buckets the thresholds follow the smoothed shares of the grades. Without any row
    nothing speaks against a document: every one gets the highest grade.
    """
    if not len(rows):
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, -40.0))
    counts = np.bincount(grades, minlength=GRADES) + 1.0
    tail = 1 - np.cumsum(counts)[:-1] / counts.sum()
    thresholds = -np.log(tail / (1 - tail))
    weights, square = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    telling = _telling(rows, grades)
    rows = [r[telling[r]] for r in rows]
    t_square = np.full(GRADES - 1, 1e-3)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            if not len(part):
                continue
            sizes = np.array([len(rows[i]) for i in part])
            spots = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            score = np.bincount(owner, weights=weights[spots], minlength=len(part))
            # Edge probabilities around each grade: 1 above, 0 below all thresholds.
            above = OrdinalModel(weights, thresholds).tails(score)
            edges = np.c_[np.ones(len(part)), above, np.zeros(len(part))]
            y = grades[part]
            at = np.arange(len(part))
            upper, lower = edges[at, y], edges[at, y + 1]
            p = np.maximum(upper - lower, 1e-9)
            d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
            slope = d_lower - d_upper  # of the loss by the score
            g = np.bincount(spots, weights=slope[owner], minlength=0)
            used = np.flatnonzero(np.bincount(spots))
            step = g[used] / len(part) + shrink * weights[used]
            square[used] += step**2
            weights[used] -= rate * step / np.sqrt(square[used])
            t = np.zeros(GRADES - 1)
            np.add.at(t, y[y > 0] - 1, d_upper[y > 0])
            np.add.at(t, y[y < GRADES - 1], -d_lower[y < GRADES - 1])
            t /= len(part)
            t_square += t**2
            thresholds = np.sort(thresholds - rate * t / np.sqrt(t_square))
    return OrdinalModel(weights.astype(np.float32), thresholds)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 poor, 2 good. Rows with a null are left out; of several the worst counts."""
    grade = F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit_on_sample(docs: DataFrame, ratings: DataFrame, most: int = MAX_LABELLED) -> OrdinalModel:
    """Fit on the documents of at most ``most`` ratings (doc_id, grade), chosen by hashed id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features()
        for batch in batches:
            found = [known.of(t).astype("<i4").tobytes() for t in raw_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(found, pa.binary())], ["doc_id", "grade", "f"])

    sample = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` pairs of numbers: broadcast whatever the size of the tables.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    made = chosen.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, grade int, f binary").collect()
    made.sort(key=lambda r: (r["doc_id"], r["grade"], bytes(r["f"])))
    return fit([np.frombuffer(r["f"], "<i4").astype(np.int64) for r in made], np.array([r["grade"] for r in made], np.int64))


def grader(spark: SparkSession, model: OrdinalModel, keep_from: int = KEEP_FROM) -> Callable[[Column], Column]:
    """A function of a text column: (expected_grade, tail_probability of ``keep_from``)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected_grade:double,tail_probability:double>")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, own = Features(), shared.value
        for texts in parts:
            scores = np.array([own.weights[known.of(t.encode())].sum(dtype=np.float64) for t in texts])
            tails = own.tails(scores)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail_probability": tails[:, keep_from - 1]})

    return lambda text: judge(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: OrdinalModel, keep_from: int = KEEP_FROM, least: float = MIN_PROBABILITY) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` of ``keep_from`` and ``kept``; such columns are replaced.

    Whole texts are read. A null or empty text, or one of blanks, has no features and gets the grade
    of the thresholds alone. Equal texts get equal results; all rows and other columns stay.
    """
    out = docs.withColumn("_judged", grader(docs.sparkSession, model, keep_from)(F.col("text")))
    return out.withColumns(
        {
            "expected_grade": F.col("_judged.expected_grade"), "tail_probability": F.col("_judged.tail_probability"),
            "kept": F.col("_judged.tail_probability") >= least,
        }
    ).drop("_judged")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_sample(docs, graded(table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", "expected_grade", "tail_probability", "kept")
