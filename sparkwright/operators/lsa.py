"""A fitted text embedder: truncated singular value decomposition of the documents' term matrix.

The matrix has a row for each document and a column for each of the `vocabulary` most frequent terms; an entry is
(1 + ln tf) idf, and a row has length 1. The right singular vectors are found by randomised power iteration: a
matrix of a few more columns than wanted is multiplied by the matrix and by its transpose in one pass over the
documents, made orthonormal, and again. Each task adds up the rows that it has; the sums meet by term, with
a part of each term's row from each task. What the driver holds is that one matrix, of `vocabulary` rows, whatever the number of
documents. New texts are embedded by the same terms, weights and vectors.

Terms are counted where a text lies, by batch in numpy: neither texts nor postings are shuffled, but for tables that lie in too few parts.
A document is a row when fitted; when embedded, rows of one id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions.batches import BATCH_BYTES, bounded_batches
from sparkwright.functions.ordering import written
from sparkwright.functions.words import pieces, word_points, word_ranges, words
from sparkwright.operators.sparse import terms

#: Terms that the fit knows: the most frequent ones by documents, ties by term.
VOCABULARY = 20_000
DIM = 64
EXTRA = 16
ROUNDS = 4
#: Rows that are multiplied at once.
BLOCK = 256
#: Bytes of text of a part, where texts have to be dealt out.
PART_BYTES = 64 << 20
_MODEL = "term string, column int, idf double, vector array<double>"


@dataclass
class Embedder:
    """terms(term, column, idf, vector: the term's row of the right singular vectors), and the singular values."""

    terms: DataFrame
    values: np.ndarray


@dataclass
class Rows:
    """Some rows of the term matrix: row i has columns[offsets[i]:offsets[i + 1]], in ascending order, and how often each term occurs."""

    offsets: np.ndarray
    columns: np.ndarray
    counts: np.ndarray

    def blocks(self, idf: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Of BLOCK rows each: which rows, what columns they have, and the weights in these columns, to length 1."""
        for at in range(0, len(self.offsets) - 1, BLOCK):
            own = self.offsets[at : at + BLOCK + 1]
            columns, counts = self.columns[own[0] : own[-1]], self.counts[own[0] : own[-1]]
            row, weights = np.repeat(np.arange(len(own) - 1), np.diff(own)), (1 + np.log(counts)) * idf[columns]
            norm = np.sqrt(np.bincount(row, weights * weights, len(own) - 1))
            seen = np.zeros(len(idf), bool)
            seen[columns] = True
            place = np.cumsum(seen) - 1
            out = np.zeros((len(own) - 1, int(seen.sum())))
            out[row, place[columns]] = weights / norm[row]
            yield slice(at, at + len(own) - 1), np.flatnonzero(seen), out


def spread(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of the rows in parts that keep all cores busy: where they lie, or as a table in the shared folder if they lie in a few large parts."""
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    parts = own.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text")).alias("bytes"))
    every, largest = (x or 0 for x in parts.agg(F.sum("bytes"), F.max("bytes")).first())
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if largest <= BATCH_BYTES or largest * cores <= 2 * every:
        return own
    return written(own.repartition(max(cores, -(-every // PART_BYTES)), F.monotonically_increasing_id()), "texts")  # by row, whatever the ids


def _lower(own: DataFrame) -> DataFrame:
    return own.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def _frequencies(own: DataFrame, ranges: np.ndarray) -> DataFrame:
    """(term, df): rows of own(text) that have a term. A batch's are added up where it is read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = word_points(ranges)
        for b in batches:
            for part in pieces(b.column(0)):
                found, row = words(b.column(0)[part], points)
                found = found.dictionary_encode()
                known = len(found.dictionary)
                held = _runs(row * known + found.indices.to_numpy())[0]
                df = np.bincount(held % max(known, 1), minlength=known)
                yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.string()), pa.array(df, pa.int64())], ["term", "df"])

    return own.select("text").mapInArrow(work, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each one occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def _counted(texts: pa.Array, points: np.ndarray, known: pa.Array) -> Rows:
    """Of texts: rows of the known terms' counts."""
    found, row = words(texts, points)
    column = pc.index_in(found, value_set=known).fill_null(-1).to_numpy()
    has = column >= 0
    keys, counts = _runs(row[has] * len(known) + column[has])
    row, column = np.divmod(keys, max(len(known), 1))
    return Rows(np.searchsorted(row, np.arange(len(texts) + 1)), column.astype(np.int32), counts.astype(np.int32))


def _matrix(own: DataFrame, ranges: np.ndarray, known: list[str]) -> DataFrame:
    """(columns, counts) of the rows of own(text) that have a known term, each as bytes of whole numbers: a value in Spark for a row, not for a term."""
    sent = own.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, known = word_points(ranges), pa.array(sent.value, pa.large_string())
        for b in batches:
            for part in pieces(b.column(0)):
                rows = _counted(b.column(0)[part], points, known)
                offsets = np.unique(rows.offsets).astype(np.int32) * 4  # without empty rows
                packed = [pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(x)]) for x in (rows.columns, rows.counts)]
                yield pa.RecordBatch.from_arrays(packed, ["columns", "counts"])

    return own.select("text").mapInArrow(work, "columns binary, counts binary")


def _times(rows: DataFrame, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A'(A matrix) of the rows A, in one pass."""
    sent = rows.sparkSession.sparkContext.broadcast((idf, matrix))
    n, width = matrix.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, matrix = sent.value
        out, used = np.zeros((n, width)), np.zeros(n, bool)
        for b in batches:
            columns, counts = (x.cast(pa.large_binary()) for x in b.columns)
            offsets = np.frombuffer(columns.buffers()[1], np.int64)[columns.offset : columns.offset + b.num_rows + 1] // 4
            own = Rows(offsets, *(np.frombuffer(x.buffers()[2] or b"", np.int32) for x in (columns, counts)))
            for _, which, weights in own.blocks(idf):
                out[which] += weights.T @ (weights @ matrix[which])
                used[which] = True
        (which,) = np.nonzero(used)
        for at in range(0, len(which), 1024):
            part = which[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(out[part].ravel()), width).cast(pa.list_(pa.float64()))], ["column", "part"])

    parts = rows.select("columns", "counts").mapInArrow(work, "column int, part array<double>")
    sums = parts.groupBy("column").agg(*(F.sum(F.col("part")[i]).alias(f"c{i}") for i in range(width))).toPandas()
    out = np.zeros((n, width))
    out[sums["column"].to_numpy()] = sums.drop(columns="column").to_numpy()
    sent.destroy()
    return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dim: int = DIM, vocabulary: int = VOCABULARY, rounds: int = ROUNDS, seed: int = 7) -> Embedder:
    """From all documents; null texts count as empty. With fewer terms or documents than dim there are fewer dimensions."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ranges = word_ranges(spark)
    own, n = _lower(spread(docs, doc_id, text)), docs.count()
    kept = _frequencies(own, ranges).orderBy(F.desc("df"), "term").limit(vocabulary).toPandas().sort_values("term")  # bounded by `vocabulary`
    if not len(kept):
        return Embedder(spark.createDataFrame([], _MODEL), np.zeros(0))
    idf = np.log((n + 1) / (kept["df"].to_numpy() + 1)) + 1
    known = kept["term"].tolist()
    rows = written(_matrix(own, ranges, known), "term-rows")
    width = min(dim + EXTRA, len(kept))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(kept), width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(_times(rows, idf, basis))[0]
    # within the basis the decomposition is that of a small matrix
    small = basis.T @ _times(rows, idf, basis)
    squares, turned = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-squares)[: min(dim, int((squares > 1e-10).sum()))]
    vectors, values = basis @ turned[:, order], np.sqrt(squares[order])
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1, 1)
    model = list(zip(known, range(len(known)), idf.tolist(), vectors.tolist()))
    return Embedder(spark.createDataFrame(model, _MODEL), values)


def save(model: Embedder, path: str) -> None:
    model.terms.write.mode("overwrite").parquet(f"{path}/terms")
    rows = [(i, v) for i, v in enumerate(model.values.tolist())]
    model.terms.sparkSession.createDataFrame(rows, "dimension int, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/values")


def load(spark: SparkSession, path: str) -> Embedder:
    values = spark.read.schema("dimension int, value double").parquet(f"{path}/values").orderBy("dimension").toPandas()["value"]
    return Embedder(spark.read.schema(_MODEL).parquet(f"{path}/terms"), values.to_numpy())


def embed(model: Embedder, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: bool = True, whiten: bool = False) -> DataFrame:
    """(doc_id, vec) of every row of docs: its projection on the right singular vectors, to length 1 if `unit`; all zeros without a known term
    or an id. The words of rows that share an id count together.

    With `whiten` the projections are divided by the singular values first, so that all directions count alike, not the most common
    words' most. Without unit length those are the rows of the left singular vectors.
    """
    spark, dim = docs.sparkSession, len(model.values)
    bounded_batches(spark)
    table = model.terms.orderBy("column").toPandas()  # bounded by the vocabulary
    vectors = np.array(table["vector"].tolist()).reshape(len(table), dim)
    sent = spark.sparkContext.broadcast((table["term"].tolist(), table["idf"].to_numpy(float), vectors / model.values if whiten else vectors))
    ranges = word_ranges(spark)

    def projected(rows: Rows, idf: np.ndarray, vectors: np.ndarray) -> pa.Array:
        out = np.zeros((len(rows.offsets) - 1, dim))
        for which, used, weights in rows.blocks(idf):
            out[which] = weights @ vectors[used]
        if unit and dim:
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, norm, out=out, where=norm > 1e-12)
        offsets = np.arange(len(out) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf, vectors = sent.value
        points, known = word_points(ranges), pa.array(known, pa.large_string())
        for b in batches:
            for part in pieces(b.column(1)):
                vec = projected(_counted(b.column(1)[part], points, known), idf, vectors)
                yield pa.RecordBatch.from_arrays([b.column(0)[part], vec], ["doc_id", "vec"])

    def of_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, idf, vectors = sent.value
        for b in batches:
            x = b.column(1)
            rows = Rows(x.offsets.to_numpy(), *(x.values.field(i).to_numpy() for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), projected(rows, idf, vectors)], ["doc_id", "vec"])

    own = _lower(spread(docs, doc_id, text))
    own = own.withColumn("text", F.when(F.col("doc_id").isNotNull(), F.col("text")).otherwise(""))
    shared = own.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if shared.isEmpty():
        return own.mapInArrow(of_texts, "doc_id bigint, vec array<double>")
    shared = written(shared, "shared-ids")
    alone = own.join(shared, "doc_id", "left_anti").mapInArrow(of_texts, "doc_id bigint, vec array<double>")
    both = own.join(shared, "doc_id", "left_semi")
    known = F.broadcast(model.terms.select("term", "column"))  # bounded by the vocabulary
    counts = terms(both, "doc_id", F.col("text")).join(known, "term").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("column", F.col("tf").cast("int").alias("tf")))).alias("counts"))
    found = counts.mapInArrow(of_counts, "doc_id bigint, vec array<double>")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return alone.unionByName(both.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("vec", zeros).alias("vec")))
