"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A vector is normalised, padded to a power of two and turned by three rounds of random signs and a
fast Hadamard transform. Its hash is the signed axis that it then lies nearest to. A table joins the
hashes of some turns into one code, the last one of some axes only, so that there are about as many
codes as vectors at every size; a query looks into its own bucket and into those whose axes are next
nearest in all, more of them the more vectors there are. Equal vectors count as one while searching,
so a frequent vector is one entry.

Codes of the index and codes that queries look into meet in one shuffle join; large buckets are
split. Each vector is then sent, with the numbers of the queries that found it, to be compared
exactly, by blocks of queries of bounded size, and each query's k best are kept, by task first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwright.llm.common import discard, stored

TABLES = 32
#: Vectors that a query's buckets of a table hold on average: this times the number of distinct vectors to that power
#: (of random directions, whose neighbours are far, recall then falls slowly: 0.97 of 10,000 and 0.95 of 200,000).
HELD, POWER = 1.45, 0.4
LEAST_PROBES = 8
SEED = 12345
#: Bytes of query vectors that are sent to the executors at once.
BLOCK_BYTES = 64 << 20
#: Entries of a bucket beyond which it is split.
BUCKET = 4096
#: More large buckets than this and they are joined by shuffle.
BROADCAST_BUCKETS = 100_000
PAIRS = 1 << 16


def axes_of(n: int, size: int) -> list[int]:
    """How many axes each turn of a table has, of `size` or fewer: the products of twice as many come near n from below."""
    out, left = [], float(n)
    while left >= 2:
        out.append(min(size, 1 << int(np.log2(left / 2))))
        left /= 2 * out[-1]
    return out or [1]


class CrossPolytope:
    """`tables` codes for a vector, each of as many signed axes as `axes` has turns."""

    def __init__(self, dim: int, tables: int, axes: list[int], seed: int = SEED):
        self.dim, self.size = dim, 1 << max(1, int(np.ceil(np.log2(max(2, dim)))))
        self.tables, self.axes = tables, axes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables * len(axes), 3, self.size))

    @staticmethod
    def size_of(dim: int) -> int:
        return 1 << max(1, int(np.ceil(np.log2(max(2, dim)))))

    def turn(self, x: np.ndarray, k: int) -> np.ndarray:
        """Three rounds of signs and the fast Hadamard transform."""
        for signs in self.signs[k]:
            x = x * signs
            h = 1
            while h < self.size:
                y = x.reshape(len(x), -1, 2, h)
                x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), -1)
                h *= 2
            x = x / np.sqrt(self.size)
        return x

    def _turned(self, vectors: np.ndarray) -> np.ndarray:
        x = np.zeros((len(vectors), self.size))
        # by the largest component first: no overflow of the squares
        x[:, : self.dim] = vectors / np.abs(vectors).max(1, keepdims=True)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(n, tables): the nearest signed axes and the table, as one number."""
        x = self._turned(vectors)
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for k, axes in enumerate(self.axes):
                y = self.turn(x, t * len(self.axes) + k)[:, :axes]
                out[:, t] = out[:, t] * 2 * axes + np.concatenate([y, -y], 1).argmax(1)
            out[:, t] = out[:, t] * self.tables + t
        return out

    def probes(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """(n, tables, probes or as many as there are): the codes whose axes are nearest, by the sum of what each turn loses, the own one first."""
        probes = min(probes, int(np.prod([2.0 * a for a in self.axes])))
        x, out = self._turned(vectors), []
        for t in range(self.tables):
            code, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for k, axes in enumerate(self.axes):
                y = self.turn(x, t * len(self.axes) + k)[:, :axes]
                both = np.concatenate([y, -y], 1)
                near = np.argsort(-both, axis=1, kind="stable")[:, :probes]
                value = np.take_along_axis(both, near, 1)
                # of the i-th best code so far and the j-th best axis, (i + 1)(j + 1) pairs are as good or better
                i, j = (a.ravel() for a in np.indices((code.shape[1], near.shape[1])))
                some = (i + 1) * (j + 1) <= probes
                i, j = i[some], j[some]
                total = loss[:, i] + (value[:, :1] - value)[:, j]
                best = np.argsort(total, axis=1, kind="stable")[:, :probes]
                loss = np.take_along_axis(total, best, 1)
                code = np.take_along_axis(code[:, i] * 2 * axes + near[:, j], best, 1)
            out.append(code * self.tables + t)
        return np.stack(out, 1)


def valid(vectors: DataFrame) -> DataFrame:
    """(id bigint, v array<double>): without vectors that are null, empty or zero or hold null or non-finite components."""
    own = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("id").isNotNull() & (F.size("v") > 0)).where(fine & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(q: np.ndarray, d: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k nearest, ties to the smaller id."""
    order = np.lexsort((i, d, q))
    q = q[order]
    first = np.searchsorted(q, q, "left")
    return order[np.arange(len(q)) - first < k]


def search(vectors: DataFrame, every: int = 100, k: int = 10, tables: int = TABLES, held: float = HELD, exact: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (query_id, rank, vec_id, score): for each row whose vec_id is divisible
    by `every` the k nearest rows found but itself, by Euclidean distance in double precision on the vectors
    as they are; ties to the smaller vec_id. All others are candidates, and if they are fewer than k, all are found.

    Rows whose vector is null, empty or zero, holds null or non-finite components or has another length than
    most take no part, nor do null ids. Of rows with equal vectors each has its own rank. A row that repeats
    another's id is the same row; of several vectors for one id the first in order counts. An empty table
    gives no row; other columns are ignored. A query whose buckets hold fewer than k rows is compared with all
    vectors, and so is every query with exact=True.
    """
    spark = vectors.sparkSession
    rows = valid(vectors).groupBy("id").agg(F.min("v").alias("v"))
    rows = stored(rows, "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if lengths is None:
        return none
    dim = lengths["n"]
    rows = rows.where(F.size("v") == dim)

    # equal vectors: one entry, which knows its k + 1 smallest ids. Salted, so that no task gets all of a frequent vector's rows.
    near = lambda w: F.row_number().over(Window.partitionBy(*w).orderBy("id"))
    few = rows.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = few.withColumn("r", near(["h", "v", "salt"])).where(F.col("r") <= k + 1)
    few = few.groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    index = stored(few.select(F.get("ids", F.lit(0)).alias("entry"), "v", "ids"), "index")
    n, asked = index.count(), rows.where(F.col("id") % every == 0)
    n_asked = asked.count()
    blocks = max(1, -(-n_asked * dim * 8 // block_bytes))
    asked = asked.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    out = None
    if not exact:
        lsh = CrossPolytope(dim, tables, axes_of(n, CrossPolytope.size_of(dim)))
        probes = max(LEAST_PROBES, int(np.ceil(held * n**POWER * np.prod([2.0 * a for a in lsh.axes]) / max(1, n))))
        pairs = stored(_candidates(index, asked, lsh, probes), "candidates")
        for i in range(blocks):
            own = index.join(pairs.where(F.col("blk") == i), "entry").select("v", "ids", "queries")
            found = _nearest(own, asked.where(F.col("blk") == i), k, dim)
            out = found if out is None else out.unionByName(found)
        out = stored(out, "found")
        discard(pairs)
        enough = out.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        asked = stored(asked.join(enough, F.col("id") == F.col("query_id"), "left_anti"), "short")
    short = asked.count()
    blocks = -(-short * dim * 8 // block_bytes)
    for i in range(blocks):
        whole = index.select("v", "ids", F.lit(None).cast("array<bigint>").alias("queries"))
        found = _nearest(whole, asked.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == i), k, dim)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return none
    # a short query's few finds are among those of its full comparison
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")) if short and not exact else out
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _candidates(index: DataFrame, asked: DataFrame, lsh: CrossPolytope, probes: int) -> DataFrame:
    """(entry, blk, queries): of each entry the queries, by block, that look into one of its buckets."""

    def keyed(of) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    found = of(_matrix(part.column(2), lsh.dim)).reshape(part.num_rows, -1)
                    offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["id", "blk", "codes"])

        return work

    schema = "id bigint, blk int, codes array<bigint>"
    held = index.select("entry", F.lit(0).alias("blk"), "v").mapInArrow(keyed(lsh.codes), schema).select(F.col("id").alias("entry"), F.explode("codes").alias("code"))
    held = stored(held, "codes")
    looked = asked.select("id", "blk", "v").mapInArrow(keyed(lambda x: lsh.probes(x, probes)), schema).select(F.col("id").alias("query"), "blk", F.explode("codes").alias("code"))
    large = held.groupBy("code").count().where(F.col("count") > BUCKET).select("code", F.ceil(F.col("count") / BUCKET).cast("int").alias("parts"))
    large = stored(large, "large-buckets")
    sent = F.broadcast(large) if large.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS else large
    part = F.pmod(F.xxhash64("entry"), F.coalesce("parts", F.lit(1))).cast("int")
    held = held.join(sent, "code", "left").select("code", "entry", part.alias("part"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    looked = looked.join(sent, "code", "left").select("code", "query", "blk", every.alias("part"))
    return looked.join(held, ["code", "part"]).groupBy("entry", "blk").agg(F.collect_set("query").alias("queries"))


def _nearest(entries: DataFrame, asked: DataFrame, k: int, dim: int) -> DataFrame:
    """entries(v, ids, queries; null for all) and a block's queries (id, v) -> (query_id, vec_id, score), of each task the k best for each query."""
    own = asked.select("id", "v").toArrow().sort_by("id")
    if not own.num_rows:
        return entries.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    sent = entries.sparkSession.sparkContext.broadcast((own["id"].to_numpy(), _matrix(own["v"].combine_chunks(), dim)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        q, d, v = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                mine, names = _matrix(part.column(0), dim), part.column(1)
                sizes, flat = names.value_lengths().to_numpy(), names.flatten().to_numpy()
                starts = np.cumsum(sizes) - sizes
                if part.column(2).null_count:
                    row, query = (x.ravel() for x in np.indices((len(mine), len(ids))))
                else:
                    row = np.repeat(np.arange(len(mine)), part.column(2).value_lengths().to_numpy())
                    query = np.searchsorted(ids, part.column(2).flatten().to_numpy())
                for cut in range(0, len(row), PAIRS):
                    r, f = row[cut : cut + PAIRS], query[cut : cut + PAIRS]
                    gap = mine[r] - matrix[f]
                    away = np.sqrt((gap * gap).sum(1))
                    n = sizes[r]
                    place = np.repeat(starts[r] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    f, away, name = np.repeat(f, n), np.repeat(away, n), flat[place]
                    other = name != ids[f]
                    q, d, v = np.concatenate([q, f[other]]), np.concatenate([d, away[other]]), np.concatenate([v, name[other]])
                    best = _best(q, d, v, k)
                    q, d, v = q[best], d[best], v[best]
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v), pa.array(d)], ["query_id", "vec_id", "score"])

    return entries.mapInArrow(work, "query_id bigint, vec_id bigint, score double")
