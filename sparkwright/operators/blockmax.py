"""BM25 Okapi over postings in blocks, with dynamic pruning: ranges of documents that can't reach a query's k best aren't scored.

Documents are numbered in an order (by what is given, then by id) and cut into ranges of SPAN; a block is a term's
postings in one range, with the largest impact that any of them has. The ranges are the same for all terms, so the sum of
its blocks' largest impacts, weighted as the query weighs the terms, bounds every score in a range. A row of the index is
a range with all of its blocks, so bounds and scores are products of matrices where the row lies: what is shuffled is each
task's best, never a row for each query and range. For each query

1. the bounds of all ranges are summed from block heads, without reading a posting;
2. the ranges with the largest bounds are scored: their k-th best score is a threshold that the answer can't fall below;
3. of the other ranges only those are scored whose bound reaches the threshold.

The result is that of scoring everything. An order that brings like documents together makes the bounds tighter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions.ordering import numbered, written
from sparkwright.operators.sparse import top_k

SPAN = 32
DIGITS = 6
BLOCKS = "range bigint, heads array<struct<term: string, largest: double, n: bigint>>, entries array<array<struct<doc_id: bigint, impact: double>>>"
TERMS = "term string, idf double, df bigint"
#: Postings that a task of build() has.
TASK_POSTINGS = 1_000_000
#: Queries that are sent to the index at once, and of these that are multiplied at once.
BLOCK, ROWS = 4096, 128
#: Blocks that a task multiplies at once, and cells of a matrix.
CHUNK, CELLS = 100_000, 2_000_000


@dataclass
class Index:
    """blocks(range, heads, entries), terms(term, idf, df), and the ranges' span."""

    blocks: DataFrame
    terms: DataFrame
    span: int


def build(postings: DataFrame, docs: DataFrame, path: str, order: list[str] | None = None, span: int = SPAN, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> Index:
    """postings(doc_id, term, tf, len), docs(doc_id, ...): every document, empty ones too -> the index, kept under path.

    A negative idf becomes epsilon times the mean idf of all terms. `order` names columns of docs by which like documents
    come together; the rest of the order is doc_id. What stood under path is replaced.
    """
    spark = postings.sparkSession
    keys = [*(order or []), "doc_id"]
    placed = numbered(docs.select(*keys), keys).select("doc_id", F.floor(F.col("place") / span).alias("range"))
    n = docs.count()
    sizes = postings.groupBy("doc_id").agg(F.first("len").alias("len"))
    mean_len = (sizes.agg(F.sum("len")).first()[0] or 0) / max(1, n)
    df = written(postings.groupBy("term").agg(F.count("*").alias("df")), "df")
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean_idf, total = df.agg(F.avg(raw), F.sum("df")).first()
    terms = df.select("term", F.when(raw < 0, F.lit(epsilon * (mean_idf or 0.0))).otherwise(raw).alias("idf"), "df")
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean_len or 1.0)))
    # dealt by range once: a range's blocks, and its row, are made where its postings lie
    dealt = postings.join(placed, "doc_id").select("range", "term", F.struct("doc_id", impact.alias("impact")).alias("entry"))
    dealt = dealt.repartition(max(spark.sparkContext.defaultParallelism, -(-(total or 0) // TASK_POSTINGS)), "range")
    blocks = dealt.groupBy("range", "term").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    block = F.struct("term", F.array_max("entries.impact").alias("largest"), F.size("entries").cast("bigint").alias("n"), "entries")
    rows = blocks.groupBy("range").agg(F.collect_list(block).alias("x"))
    heads = F.transform("x", lambda x: F.struct(x["term"].alias("term"), x["largest"].alias("largest"), x["n"].alias("n")))
    rows.select("range", heads.alias("heads"), F.col("x.entries").alias("entries")).write.mode("overwrite").parquet(f"{path}/blocks")
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(span,)], "span int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return Index(read("blocks", BLOCKS), read("terms", TERMS), read("about", "span int").first()[0])


@dataclass
class Weights:
    """Queries as rows of matrices: their ids, and by groups of ROWS the terms (numbers over the whole block) and each term's weight."""

    ids: np.ndarray
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    n_terms: int

    @staticmethod
    def of(query: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int) -> Weights:
        ids, row = np.unique(query, return_inverse=True)
        groups = []
        for at in range(0, len(ids), ROWS):
            own = (row >= at) & (row < at + ROWS)
            names, column = np.unique(term[own], return_inverse=True)
            groups.append((names, row[own] - at, column, weight[own]))
        return Weights(ids, groups, n_terms)

    def matrices(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Of each group its rows, the place of each term among its columns (-1: none), and the matrix."""
        for g, (names, row, column, weight) in enumerate(self.groups):
            rows = slice(g * ROWS, min(len(self.ids), (g + 1) * ROWS))
            place = np.full(self.n_terms, -1)
            place[names] = np.arange(len(names))
            w = np.zeros((rows.stop - rows.start, len(names)))
            w[row, column] = weight
            yield rows, place, w


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole ranges, CHUNK of them or so; those of a range follow each other."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            t = pa.Table.from_batches(held).combine_chunks()
            (other,) = np.nonzero(t["range"].to_numpy() != t["range"][-1].as_py())
            if len(other):
                yield t.slice(0, other[-1] + 1)
                held = t.slice(other[-1] + 1).to_batches()
                rows = sum(x.num_rows for x in held)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(t: pa.Table, weights: Weights, span: int) -> Iterator[tuple]:
    """By groups of queries and some ranges at once: the queries' rows, the terms' places, the matrix, which rows of t these are, the ranges,
    each row's range among them, and by query and range the bound and the number of postings."""
    ranges, term, largest, n = (t[c].to_numpy() for c in ("range", "t", "largest", "n"))
    names, which = np.unique(ranges, return_inverse=True)
    by = np.argsort(which, kind="stable")
    for rows, place, w in weights.matrices():
        step = max(1, CELLS // max(1, w.shape[1]) // span)
        for at in range(0, len(names), step):
            own = by[np.searchsorted(which[by], at) : np.searchsorted(which[by], at + step)]
            own = own[place[term[own]] >= 0]
            cells = place[term[own]], which[own] - at
            some = names[at : at + step]
            high, count = np.zeros((w.shape[1], len(some))), np.zeros((w.shape[1], len(some)))
            high[cells], count[cells] = largest[own], n[own]
            yield rows, place, w, own, some, cells[1], np.maximum(w, 0) @ high, (w != 0).astype(float) @ count


def _leading(batches: Iterator[pa.RecordBatch], weights: Weights, span: int, lead: int) -> Iterator[pa.RecordBatch]:
    """Of each query the `lead` largest bounds of a chunk's ranges."""
    for t in _chunks(batches):
        for rows, _, _, _, some, _, bound, count in _bounds(t, weights, span):
            bound = np.where(count > 0, bound, -np.inf)
            m = min(lead, len(some))
            at = np.argpartition(-bound, m - 1, axis=1)[:, :m]
            i, k = np.nonzero(np.isfinite(np.take_along_axis(bound, at, 1)))
            at = at[i, k]
            yield pa.RecordBatch.from_arrays([pa.array(weights.ids[rows][i]), pa.array(some[at]), pa.array(bound[i, at])], ["query_id", "range", "bound"])


def _best(batches: Iterator[pa.RecordBatch], weights: Weights, span: int, k: int, least: np.ndarray, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each query the scores of the k best, and those that tie with them, in a chunk's ranges whose bound reaches the query's floor,
    unless they fall below its `least`; and in rows without doc_id how many postings were scored."""
    room = 10.0**-DIGITS
    names = ["query_id", "doc_id", "score", "read"]
    for t in _chunks(batches):
        entries = t["entries"].combine_chunks()
        flat, offsets = entries.flatten(), entries.offsets.to_numpy() - entries.offsets[0].as_py()
        docs, impacts = flat.field("doc_id").to_numpy(), flat.field("impact").to_numpy()
        term = t["t"].to_numpy()
        for rows, place, w, own, some, col, bound, count in _bounds(t, weights, span):
            wanted = (count > 0) & (bound >= floor[rows, None])
            i, _ = np.nonzero(wanted)
            read = np.bincount(i, count[wanted], minlength=len(w)).astype(np.int64)
            ids = weights.ids[rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.float64()), pa.array(read)], names)
            hit = wanted.any(0)[col]
            own, col = own[hit], col[hit]
            if not len(own):
                continue
            sizes = offsets[own + 1] - offsets[own]
            at = np.repeat(offsets[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            found, of = np.unique(docs[at], return_inverse=True)
            impact, range_of = np.zeros((w.shape[1], len(found))), np.zeros(len(found), np.int64)
            impact[np.repeat(place[term[own]], sizes), of] = impacts[at]
            range_of[of] = np.repeat(col, sizes)
            score = np.where(wanted[:, range_of], w @ impact, 0.0)
            limit = np.maximum(least[rows], 0.0 if len(found) <= k else np.partition(score, len(found) - k, axis=1)[:, len(found) - k])
            i, d = np.nonzero((score > 0) & (score >= limit[:, None] - room))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(found[d]), pa.array(score[i, d]), pa.nulls(len(i), pa.int64())], names)


def _search(index: Index, weights: DataFrame, k: int, lead: int) -> DataFrame:
    """(query_id, doc_id, score, read) of a block of queries: _best() with the leading ranges' threshold, and a row for each query without doc_id."""
    spark = weights.sparkSession
    own = weights.toArrow()
    coded = own["term"].combine_chunks().dictionary_encode()
    each = Weights.of(own["query_id"].to_numpy(), coded.indices.to_numpy(), own["weight"].to_numpy(), len(coded.dictionary))
    sent, span = spark.sparkContext.broadcast(each), index.span
    numbers = F.broadcast(spark.createDataFrame(pa.table({"term": coded.dictionary, "t": pa.array(np.arange(len(coded.dictionary)))})))
    heads = index.blocks.select("range", F.explode("heads").alias("h")).select("range", "h.*").join(numbers, "term").select("range", "t", "largest", "n")
    first = heads.mapInArrow(lambda b: _leading(b, sent.value, span, lead), "query_id bigint, range bigint, bound double")
    first = written(top_k(first, lead, "bound", tie="range").select("query_id", "range", "bound"), "first")
    place = {q: i for i, q in enumerate(each.ids.tolist())}

    def by_query(df: DataFrame) -> np.ndarray:
        """A number for each query that has one, else none is less."""
        out = np.full(len(place), -np.inf)
        for q, x in df.collect():
            out[place[q]] = x
        return out

    def scored(blocks: DataFrame, least: np.ndarray, floor: np.ndarray) -> DataFrame:
        limits = spark.sparkContext.broadcast((least, floor))
        hit = blocks.select("range", F.explode(F.arrays_zip("heads", "entries")).alias("b")).select("range", "b.heads.*", "b.entries").join(numbers, "term")
        hit = hit.select("range", "t", "largest", "n", "entries")
        made = hit.mapInArrow(lambda b: _best(b, sent.value, span, k, *limits.value), "query_id bigint, doc_id bigint, score double, read bigint")
        return made.withColumn("score", F.round("score", DIGITS))

    # a bound is a sum in another order than a score's, or than itself in another run: it is given a digit's room
    room = 10.0**-DIGITS
    floor = by_query(first.groupBy("query_id").agg(F.min("bound"))) - room
    lead_scores = scored(index.blocks.join(F.broadcast(first.select("range").distinct()), "range", "left_semi"), np.full(len(place), -np.inf), floor)
    least = by_query(top_k(lead_scores.where("score > 0"), k).where(F.col("rank") == k).select("query_id", "score"))
    return scored(index.blocks, least, np.minimum(floor, least - room))


def search(index: Index, queries: DataFrame, k: int = 50, lead: int = 4, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, term, qtf), a stated set, sent to the index in blocks -> the k best, (query_id, rank, doc_id, score), ties by id;
    and (query_id, postings, read): how many postings the query's terms have, and how many of them were scored.

    `lead` is how many ranges are scored first, in ranges of which k documents fit; the results don't depend on it.
    """
    spark = queries.sparkSession
    weights = queries.join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).cast("double").alias("weight"), "df")
    weights = written(weights.withColumn("query_id", F.col("query_id").cast("bigint")), "weights")
    blocks, out = -(-weights.select("query_id").distinct().count() // block), None
    for i in range(blocks):
        made = _search(index, weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k, lead * -(-k // index.span))
        out = made if out is None else out.unionByName(made)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, doc_id bigint, score double, read bigint")
    best = top_k(out.where("score > 0"), k).select("query_id", "rank", "doc_id", "score")
    known = weights.groupBy("query_id").agg(F.sum("df").alias("postings"))
    read = out.where("doc_id is null").groupBy("query_id").agg(F.sum("read").alias("read"))
    return best, known.join(read, "query_id", "left").select("query_id", "postings", F.coalesce("read", F.lit(0)).cast("bigint").alias("read"))
