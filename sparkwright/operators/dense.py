"""Dense retrieval: exact maximum inner product search, in blocks of queries, and a stand-in embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkwright.functions.ordering import written
from sparkwright.operators.sparse import top_k

#: Queries that are sent to the executors at once.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    d = lambda x: x.cast("array<double>")
    return F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """To length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v.cast("array<double>"), lambda x: F.when(norm > 0, x / norm).otherwise(x))


def inner_product_top_k(queries: DataFrame, vectors: DataFrame, k: int = 50, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """queries(query_id, vec), vectors(doc_id, vec) -> (query_id, rank, doc_id, score): exact, ties by id.

    The queries are a stated set and travel in blocks of bounded size; each task keeps the k best of its
    part of the vectors for each query, and the parts' rows are merged. doc_id is a whole number or a string.
    """
    kind = "string" if isinstance(vectors.schema["doc_id"].dataType, StringType) else "bigint"
    out = vectors.sparkSession.createDataFrame([], f"query_id bigint, rank bigint, doc_id {kind}, score double")
    for own in _blocks(queries, block):
        out = out.unionByName(_best(own, vectors, k, digits))
    return out


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries, in blocks of about `block`."""
    blocks = -(-queries.count() // block)
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas().sort_values("query_id")
        yield own["query_id"].to_numpy(np.int64), np.array(own["vec"].tolist(), float)


def _best(queries: tuple[np.ndarray, np.ndarray], vectors: DataFrame, k: int, digits: int, probes: np.ndarray | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) of one block of queries over vectors(doc_id, vec), by their products as matrices: a task
    gives k rows for each query. With `probes`, (queries, cells) of booleans, vectors have a cell and meet its queries only.
    """
    named = isinstance(vectors.schema["doc_id"].dataType, StringType)
    kind, arrow = ("string", pa.string()) if named else ("bigint", pa.int64())
    sent = vectors.sparkSession.sparkContext.broadcast((*queries, probes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, probes = sent.value
        score, name = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), str if named else np.int64)
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            doc = doc.astype(str) if named else doc
            vec = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(doc), -1)
            for at in range(0, len(doc), 2048):
                near = np.round(matrix @ vec[at : at + 2048].T, digits)
                if probes is not None:
                    near[~probes[:, b.column(2).to_numpy()[at : at + 2048]]] = -np.inf
                score, name = np.concatenate([score, near], 1), np.concatenate([name, np.broadcast_to(doc[at : at + 2048], near.shape)], 1)
                best = np.lexsort((name, -score), axis=1)[:, :k] if score.shape[1] <= 4 * k else _first(score, name, k)
                score, name = np.take_along_axis(score, best, 1), np.take_along_axis(name, best, 1)
        row, column = np.nonzero(score != -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(name[row, column], arrow), pa.array(score[row, column])], ["query_id", "doc_id", "score"])

    cells = [] if probes is None else ["cell"]
    own = vectors.select(F.col("doc_id").cast(kind), F.col("vec").cast("array<double>"), *cells)
    return top_k(own.mapInArrow(work, f"query_id bigint, doc_id {kind}, score double"), k).select("query_id", "rank", "doc_id", "score")


def _first(score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Of each row the places of the k best by score, ties by name; only what reaches a row's k-th score is sorted."""
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    places = np.zeros((len(score), k), np.int64)
    clear = (score >= least).sum(1) == k
    places[clear] = np.nonzero(score[clear] >= least[clear])[1].reshape(-1, k)
    if not clear.all():
        places[~clear] = np.lexsort((name[~clear], -score[~clear]), axis=1)[:, :k]
    return places


def cells_of(n: int) -> int:
    """How many cells an inverted-file index of n vectors has."""
    return max(1, min(int(4 * n**0.5), n // 39))


def ivf_build(vectors: DataFrame, sample: int = 20_000, rounds: int = 10, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """vectors(doc_id, vec) -> (doc_id, vec, cell) and the cells' centres, fitted on at most `sample` vectors, those of the smallest hashed ids.

    Each vector's cell is that of the centre with the largest inner product. All vectors are indexed.
    """
    own = vectors.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"))
    n = own.count()
    if not n:
        return own.withColumn("cell", F.lit(0)), np.zeros((0, 0))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("vec").toArrow()["vec"].combine_chunks()
    points = chosen.flatten().to_numpy(zero_copy_only=False).reshape(len(chosen), -1)
    centres = points[np.random.default_rng(seed).choice(len(points), min(cells_of(n), len(points)), replace=False)]
    for _ in range(rounds):
        cell = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return written(_assigned(own, centres), "ivf"), centres


def _assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(doc_id, vec) with the cell whose centre has the largest inner product."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matrix = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((matrix @ sent.value.T).argmax(1).astype(np.int32))], ["doc_id", "vec", "cell"])

    return vectors.mapInArrow(assign, "doc_id bigint, vec array<double>, cell int")


def ivf_save(index: DataFrame, centres: np.ndarray, path: str) -> None:
    """ivf_build()'s results as a folder: `cells`, partitioned by cell, and `centres`. What stood there is replaced."""
    index.repartition("cell").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("cell").parquet(f"{path}/cells")
    rows = list(enumerate(centres.tolist()))
    index.sparkSession.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def ivf_open(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """What ivf_save() wrote: the vectors with their cells, and the centres, of which there are cells_of(n)."""
    centres = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").orderBy("cell").toPandas()["centre"].tolist()
    return spark.read.schema("doc_id bigint, vec array<double>, cell int").parquet(f"{path}/cells"), np.array(centres).reshape(len(centres), -1)


def ivf_add(vectors: DataFrame, path: str) -> None:
    """New vectors(doc_id, vec) into the cells of a kept index, whose centres stay."""
    _, centres = ivf_open(vectors.sparkSession, path)
    own = vectors.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"))
    _assigned(own, centres).repartition("cell").write.mode("append").partitionBy("cell").parquet(f"{path}/cells")


def ivf_top_k(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 50, nprobe: int = 64, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """queries(query_id, vec) and ivf_build()'s results -> (query_id, rank, doc_id, score): the k best of the nprobe cells
    whose centres have the largest inner products, of all cells if there are no more.

    The queries travel in blocks, with the cells that each one probes; a vector meets the queries that probe its cell.
    """
    nprobe = min(nprobe, len(centres))
    if not nprobe:
        return inner_product_top_k(queries, index, k, digits)
    out = index.sparkSession.createDataFrame([], "query_id bigint, rank bigint, doc_id bigint, score double")
    for ids, matrix in _blocks(queries, block):
        probes = np.zeros((len(ids), len(centres)), bool)
        for at in range(0, len(ids), 512):
            cells = np.argsort(-(matrix[at : at + 512] @ centres.T), axis=1, kind="stable")[:, :nprobe]
            np.put_along_axis(probes[at : at + 512], cells, True, axis=1)
        out = out.unionByName(_best((ids, matrix), index.select("doc_id", "vec", "cell"), k, digits, probes))
    return out


def hashed_embedder(dim: int = 768):
    """A deterministic stand-in for a sentence encoder: a signed, hashed bag of words of length 1."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}

        def one(text: str | None) -> list[float]:
            out = np.zeros(dim)
            for w in (text or "").lower().split():
                if w not in known:
                    h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                    known[w] = (h % dim, 1.0 if h >> 60 & 1 else -1.0)
                at, sign = known[w]
                out[at] += sign
            norm = np.linalg.norm(out)
            return (out / norm if norm else out).tolist()

        return texts.map(one)

    return embed
