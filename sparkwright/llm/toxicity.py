"""Severity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all thresholds, which ascend. The
features of a text are the distinct lower-case words (runs of letters) and their first four
letters, hashed; each counts once, as 1. Weights are fitted by proximal gradient steps of a size of
their own (AdaGrad): first with an L1 penalty above what chance gradients reach, which leaves few
features, then for those alone nearly without one. A text's score needs only a look-up for each
distinct word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import bounded_batches, col

BITS = 22
LETTERS = re.compile(r"[^\W\d_]+")
#: Labelled rows that the classifier is fitted on, at most.
MAX_TRAIN_ROWS = 6000
#: From this probability of a grade over 0 on a text is toxic: clean texts lie far below it.
THRESHOLD = 0.2


def hashed(word: str) -> tuple[int, ...]:
    """The feature of a word and, of longer ones, that of its first letters."""
    own = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
    return (own,) if len(word) <= 4 else (own, zlib.crc32(b"^" + word[:4].encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text; none for null or empty."""
    words = set(LETTERS.findall((text or "").lower()))
    return np.unique(np.fromiter((x for w in words for x in hashed(w)), np.int32))


@dataclass
class OrdinalModel:
    weights: np.ndarray  # of the hashed features
    thresholds: np.ndarray  # ascending, one less than there are grades

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """(n, grades) of the sums of weights."""
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))
        return np.diff(below, axis=1, prepend=0.0, append=1.0)

    def severity(self, score: np.ndarray) -> np.ndarray:
        p = self.probabilities(score)
        return p @ np.arange(p.shape[1])


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l1: float = 0.35, rounds: int = 60, rate: float = 0.5, min_rows: int = 3) -> OrdinalModel:
    """Features of each row and its grade (0 .. n_grades - 1) -> the model. Deterministic.

    The penalty is l1 / sqrt(rows). Features of fewer than min_rows rows get no weight. Without rows, weights are zero and the
    thresholds are 0, 1, ...; a grade without rows keeps a small prior share.
    """
    n, size = len(rows), 1 << BITS
    share = (np.bincount(grades, minlength=n_grades) + 0.5) / (n + 0.5 * n_grades) if n else np.full(n_grades, 1 / n_grades)
    theta = np.log(np.cumsum(share)[:-1] / (1 - np.cumsum(share)[:-1]))
    if not n:
        return OrdinalModel(np.zeros(size), np.arange(n_grades - 1, dtype=float))
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    which = np.concatenate(rows) if len(at) else np.zeros(0, np.int32)
    common = np.bincount(which, minlength=size) >= min_rows
    at, which = at[common[which]], which[common[which]]
    names, col = np.unique(which, return_inverse=True)
    w, past, past_t = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(theta))
    y = grades

    for k in range(8 * rounds):
        if k == rounds:  # what is left is fitted anew
            some = np.nonzero(w)[0]
            keep = w[col] != 0
            place = np.zeros(len(w), np.int64)
            place[some] = np.arange(len(some))
            at, col, names = at[keep], place[col[keep]], names[some]
            w, past, past_t = w[some], np.zeros(len(some)), np.zeros(len(theta))
        penalty = l1 / np.sqrt(n) * (1.0 if k < rounds else 0.001)
        score = np.bincount(at, w[col], minlength=n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        with np.errstate(over="ignore"):
            hi, lo = 1 / (1 + np.exp(score - edges[y + 1])), 1 / (1 + np.exp(score - edges[y]))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        # of the mean loss -log(p): by the score, and by the edges above and below
        g = np.bincount(col, ((d_hi - d_lo) / n)[at], minlength=len(w))
        g_t = np.bincount(y, -d_hi / n, minlength=n_grades)[:-1] + np.bincount(y, d_lo / n, minlength=n_grades)[1:]
        past += g * g
        past_t += g_t * g_t
        least = 0.01 if k < rounds else 1e-4
        own_rate = rate if k < rounds else 4 * rate
        step = own_rate / (np.sqrt(past) + least)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        theta = theta - own_rate * g_t / (np.sqrt(past_t) + least)
        theta = np.maximum.accumulate(theta) + np.arange(len(theta)) * 1e-6
    full = np.zeros(size)
    full[names] = w
    return OrdinalModel(full, theta)


def extract(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and `features`, of docs' text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py()) for t in b.column(b.num_columns - 1)]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, flat)], [*keep, "features"])

    bounded_batches(docs.sparkSession)
    own = docs.select(*keep, F.col("text").cast("string"))
    schema = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keep)
    return own.mapInArrow(work, f"{schema}, features array<int>")


def train(docs: DataFrame, graded: DataFrame, n_grades: int, max_rows: int = MAX_TRAIN_ROWS) -> OrdinalModel:
    """docs(doc_id, text) and graded(doc_id, grade) -> the model, of max_rows labelled rows at most.

    Of more rows those are taken whose hashed id is smallest: a documented bound, the same on each run.
    Labels that are null or of no document are passed over; of several for one id the largest counts.
    """
    graded = graded.where("doc_id is not null and grade between 0 and " + str(n_grades - 1)).groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = extract(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "grade").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    lists = rows["features"].combine_chunks() if rows.num_rows else None
    own = [] if lists is None else np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
    return fit(own, rows["grade"].to_numpy(), n_grades)


def _scored(docs: DataFrame, model: OrdinalModel, keep: tuple) -> DataFrame:
    """docs(text, ...) -> the columns to keep as k0, k1, ..., severity (the expected grade), p_toxic (of a grade over 0), grade (the likeliest)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    (some,) = np.nonzero(model.weights)
    sent = spark.sparkContext.broadcast((dict(zip(some.tolist(), model.weights[some].tolist())), model.thresholds))
    names = [f"k{i}" for i in range(len(keep))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, thresholds = sent.value
        own = OrdinalModel(np.zeros(0), thresholds)
        known: dict[str, tuple] = {}
        for b in batches:
            sums = np.zeros(b.num_rows)
            for i, value in enumerate(b.column(b.num_columns - 1)):
                seen: dict[int, float] = {}
                for w in set(LETTERS.findall((value.as_py() or "").lower())):
                    f = known.get(w)
                    if f is None:
                        f = known[w] = tuple((x, table[x]) for x in hashed(w) if x in table)
                    if f:
                        seen.update(f)
                sums[i] = sum(seen.values())
                if len(known) > 200_000:
                    known.clear()
            p = own.probabilities(sums)
            out = [pa.array(p @ np.arange(p.shape[1])), pa.array(1 - p[:, 0]), pa.array(p.argmax(1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], [*names, "severity", "p_toxic", "grade"])

    own = docs.select(*(col(k).alias(n) for k, n in zip(keep, names)), F.col("text").cast("string").alias("_text"))
    schema = "".join(f"{n} {own.schema[n].dataType.simpleString()}, " for n in names)
    return own.mapInArrow(work, schema + "severity double, p_toxic double, grade int")


def grades_of(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) -> (doc_id, grade): 0 not toxic, 1 toxic, 2 toxic and of poor quality."""
    poor = F.coalesce(F.col("quality"), F.lit(1)) == 0
    return labels.where("toxic is not null").select("doc_id", F.when(F.col("toxic") == 0, 0).when(poor, 2).otherwise(1).alias("grade"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality, toxic) -> one row for each input row:
    doc_id, severity (expected grade, 0 to 2), p_toxic, grade (the likeliest), toxic (p_toxic >= threshold).

    Null and empty texts have no feature and get the intercepts' severity; null ids and repeated rows keep
    their rows; equal texts score equally; other columns are ignored. Without labels nothing is toxic.
    """
    model = train(docs, grades_of(labels), 3, max_rows)
    fitted = bool(np.any(model.weights))
    out = _scored(docs, model, ("doc_id",)).withColumnRenamed("k0", "doc_id")
    return out.withColumn("toxic", (F.col("p_toxic") >= threshold) & F.lit(fitted))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """docs without the rows that toxicity() would call toxic; all columns are kept."""
    model = train(docs, grades_of(labels), 3, max_rows)
    if not np.any(model.weights):
        return docs
    clean = _scored(docs, model, tuple(docs.columns)).where(F.col("p_toxic") < threshold)
    return clean.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(docs.columns)))
