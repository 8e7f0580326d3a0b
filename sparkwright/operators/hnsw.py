"""A layered proximity graph for approximate inner product search, kept as Parquet adjacency rows.

Vectors fall into shards of bounded size by the hash of their id; each shard is a graph of its own, built and
searched by one task, so the index grows by shards and a query's answer merges those of all shards. One more
coordinate, what a vector's length lacks to the longest one's, makes the largest inner product the smallest distance.

In a shard equal vectors are one node with all their ids. Every node is on level 0, one in `links` of them on
level 1, and so on, by the hash of its id. On each level a node is linked to near nodes in different directions (one
is passed over if it lies nearer to one chosen before), both ways; what the level's entries, the nodes one level up,
would not reach is linked to the nearest node that they do. A search descends from the top level with a beam.

The index is a folder: `nodes`, partitioned by shard, and `about`, a row of parameters. It is reopened from there;
an update rewrites the shards of the ids that it names, by dynamic partition overwrite, and no other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions.ordering import written
from sparkwright.operators.sparse import top_k

SHARD = 20_000
LINKS = 16
#: Queries that are sent to the shards at once.
BLOCK = 4096
#: Distances that are worked out at once.
CELLS = 2_000_000
#: Of that many queries a shard measures its recall, and widens the beam until it is this.
SAMPLE = 64
RECALL = 0.95
NODES = "node bigint, members array<bigint>, vec array<double>, links array<array<bigint>>, shard int"
ABOUT = "shards int, shard_size int, links int, longest double"


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
    return np.concatenate([vectors, rest[:, None]], 1)


def _hashed(ids: np.ndarray) -> np.ndarray:
    """Of each id a number over 0 and up to 1."""
    h = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for times, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(times)
    return ((h ^ h >> np.uint64(31)) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (-2 * a) @ b.T
    d += (a**2).sum(1)[:, None]
    d += (b**2).sum(1)[None, :]
    return np.maximum(d, 0, out=d)


def _level_links(points: np.ndarray, own: np.ndarray, links: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among the points `own`, both ways: pairs of arrays (from, to), the chosen ones first, at most twice `links` of a node."""
    if len(own) < 2:
        return []
    at, n_near = points[own], min(len(own) - 1, 3 * links)
    source, target, far = [], [], []
    step = max(1, min(512, CELLS // len(own)))
    for start in range(0, len(own), step):
        part = at[start : start + step]
        d = _distances(part, at)
        rows = np.arange(len(part))
        d[rows, rows + start] = np.inf
        near = np.argpartition(d, n_near - 1, axis=1)[:, :n_near]
        near = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(d, near, 1)), axis=1), 1)
        away = np.take_along_axis(d, near, 1)
        chosen = np.full((len(part), links), -1)
        count = np.zeros(len(part), int)
        taken = np.zeros(near.shape, bool)
        for k in range(n_near):
            between = ((at[near[:, k]][:, None, :] - at[chosen]) ** 2).sum(2)
            between[chosen < 0] = np.inf
            fits = (between.min(1) >= away[:, k]) & (count < links)
            chosen[rows[fits], count[fits]] = near[fits, k]
            count += fits
            taken[:, k] = fits
        # what room is left goes to the nearest that were passed over
        left = np.cumsum(~taken, 1) <= (links - count)[:, None]
        keep = taken | (~taken & left)
        i, k = np.nonzero(keep)
        source.append(i + start)
        target.append(near[i, k])
        far.append(away[i, k])
    a, b, d = np.concatenate(source), np.concatenate(target), np.concatenate(far)
    order = np.lexsort((np.concatenate([d, d]), np.repeat([0, 1], len(a)), np.concatenate([a, b])))
    s, t = np.concatenate([a, b])[order], np.concatenate([b, a])[order]
    first = np.sort(np.unique(s * len(own) + t, return_index=True)[1])
    s, t = s[first], t[first]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    fits = place < 2 * links
    return [(own[s[fits]], own[t[fits]])]


def _reached(n: int, lists: list[np.ndarray], entries: np.ndarray) -> np.ndarray:
    seen = np.zeros(n, bool)
    seen[entries] = True
    now = entries
    while len(now):
        now = np.unique(np.concatenate([lists[i] for i in now])) if len(now) else now
        now = now[~seen[now]]
        seen[now] = True
    return seen


def _connected(points: np.ndarray, own: np.ndarray, lists: list[np.ndarray], entries: np.ndarray) -> None:
    """Links what the entries don't reach to the nearest node that they do, both ways."""
    seen = _reached(len(points), lists, entries)
    while True:
        lost = own[~seen[own]]
        if not len(lost):
            return
        known, best = own[seen[own]], (np.inf, -1, -1)
        step = max(1, min(512, CELLS // len(known)))
        for start in range(0, len(lost), step):
            d = _distances(points[lost[start : start + step]], points[known])
            i, k = divmod(int(d.argmin()), len(known))
            if d[i, k] < best[0]:
                best = (d[i, k], int(lost[start + i]), int(known[k]))
        _, x, y = best
        lists[x], lists[y] = np.append(lists[x], y), np.append(lists[y], x)
        seen |= _reached(len(points), lists, np.array([x]))


def build_shard(ids: np.ndarray, vectors: np.ndarray, longest: float, links: int = LINKS) -> list[tuple]:
    """(node, members, vec, links by level) of distinct vectors; node is the smallest of its members."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    _, first, which = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    members = [[] for _ in first]
    for i, w in zip(ids.tolist(), which.ravel().tolist()):
        members[w].append(i)
    names, points = ids[first], _lifted(vectors[first], longest)
    level = np.minimum((-np.log(_hashed(names)) / np.log(links)).astype(int), 8)
    level[np.lexsort((names, -level))[0]] += 1  # one node alone is at the top
    by_level: list[list[np.ndarray]] = []
    for k in range(int(level.max()) + 1):
        own = np.nonzero(level >= k)[0]
        lists = [np.zeros(0, int) for _ in names]
        for s, t in _level_links(points, own, links):
            starts = np.searchsorted(s, np.arange(len(names) + 1))
            lists = [t[a:b] for a, b in zip(starts[:-1], starts[1:])]
        entries = np.nonzero(level > k)[0]
        _connected(points, own, lists, entries if len(entries) else own[:1])
        by_level.append(lists)
    return [(int(names[i]), members[i], vectors[first[i]].tolist(), [names[by_level[k][i]].tolist() for k in range(level[i] + 1)]) for i in range(len(names))]


@dataclass
class Graph:
    """A shard in memory: its points, and each level's links as a table filled up with -1."""

    names: np.ndarray
    members: list
    points: np.ndarray
    tables: list[np.ndarray]
    top: np.ndarray

    @staticmethod
    def of(rows: pd.DataFrame, longest: float) -> Graph:
        rows = rows.sort_values("node")
        names = rows["node"].to_numpy(np.int64)
        levels = [[np.asarray(x, np.int64) for x in own] for own in rows["links"]]
        tables = []
        for k in range(max(map(len, levels))):
            lists = [own[k] if k < len(own) else np.zeros(0, np.int64) for own in levels]
            sizes = np.array(list(map(len, lists)))
            table = np.full((len(names), max(1, int(sizes.max()))), -1)
            table[np.arange(table.shape[1]) < sizes[:, None]] = np.searchsorted(names, np.concatenate(lists))
            tables.append(table)
        top = np.array([i for i, own in enumerate(levels) if len(own) == len(tables)])
        return Graph(names, rows["members"].tolist(), _lifted(np.array(rows["vec"].tolist(), float), longest), tables, top)

    def _beam(self, queries: np.ndarray, entries: np.ndarray, table: np.ndarray, width: int, compared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the `width` nearest points met from its entries (-1: none) on, and their distances; all queries step at once."""
        n_queries = len(queries)
        seen = np.zeros((n_queries, len(self.points)), bool)

        def distance(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
            fresh = (found >= 0) & ~seen[rows[:, None], found]
            i, k = np.nonzero(fresh)
            seen[rows[i], found[i, k]] = True
            out = np.full(found.shape, np.inf)
            out[i, k] = ((self.points[found[i, k]] - queries[rows[i]]) ** 2).sum(1)
            compared[rows] += fresh.sum(1)
            return out

        beam = np.full((n_queries, width + entries.shape[1]), -1)
        beam[:, : entries.shape[1]] = entries
        far = distance(np.arange(n_queries), beam)
        open_ = np.isfinite(far)
        active = np.arange(n_queries)
        while len(active):
            order = np.lexsort((beam[active], far[active]), axis=1)[:, :width]
            own, d, todo = (np.take_along_axis(x[active], order, 1) for x in (beam, far, open_))
            todo &= np.isfinite(d)
            go = todo.any(1)
            pick = np.where(todo, d, np.inf).argmin(1)
            rows = np.arange(len(active))
            current = own[rows, pick]
            todo[rows, pick] = False
            beam[active, :width], far[active, :width], open_[active, :width] = -1, np.inf, False
            w = own.shape[1]
            beam[active, :w], far[active, :w], open_[active, :w] = own, d, todo
            beam[active, width:], far[active, width:], open_[active, width:] = -1, np.inf, False
            active, current = active[go], current[go]
            if not len(active):
                break
            found = table[current]
            d = distance(active, found)
            if beam.shape[1] < width + found.shape[1]:
                more = ((0, 0), (0, width + found.shape[1] - beam.shape[1]))
                beam, far, open_ = np.pad(beam, more, constant_values=-1), np.pad(far, more, constant_values=np.inf), np.pad(open_, more)
            at = slice(width, width + found.shape[1])
            beam[active, at], far[active, at], open_[active, at] = np.where(np.isfinite(d), found, -1), d, np.isfinite(d)
        return beam[:, :width], far[:, :width]

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, width) nearest points, -1 for none, and how many distances each query took."""
        compared = np.zeros(len(queries), np.int64)
        lifted = np.concatenate([queries, np.zeros((len(queries), 1))], 1)
        found = np.broadcast_to(self.top[None, :1], (len(queries), 1))
        for k in range(len(self.tables) - 1, -1, -1):
            found, _ = self._beam(lifted, found, self.tables[k], width if k == 0 else min(width, 8), compared)
        return found, compared


def shard_of(doc_id, shards: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def _shards(vectors: DataFrame, shards: int, links: int, longest: float) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = build_shard(pdf["doc_id"].to_numpy(np.int64), np.array(pdf["vec"].tolist(), float), longest, links)
        return pd.DataFrame(rows, columns=["node", "members", "vec", "links"]).assign(shard=int(pdf["shard"].iloc[0]))

    return vectors.withColumn("shard", shard_of(F.col("doc_id"), shards)).groupBy("shard").applyInPandas(build, NODES)


def _own(vectors: DataFrame) -> DataFrame:
    """Vectors with an id; those that are null or empty, or hold null or NaN, take no part."""
    own = vectors.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec")).where("doc_id is not null and size(vec) > 0")
    return own.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))


def _longest(vectors: DataFrame) -> tuple[int, float]:
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    n, longest = vectors.agg(F.count("*"), F.max(norm)).first()
    return n, longest or 0.0


def build(vectors: DataFrame, path: str, links: int = LINKS, shard_size: int = SHARD) -> None:
    """vectors(doc_id, vec), of one length, into an index folder, which is written anew. Each id should stand once."""
    if links < 2:
        raise ValueError("links must be 2 at least")
    spark, own = vectors.sparkSession, _own(vectors)
    n, longest = _longest(own)
    shards = max(1, -(-n // shard_size))
    _shards(own, shards, links, longest).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shard").parquet(f"{path}/nodes")
    spark.createDataFrame([(shards, shard_size, links, longest)], ABOUT).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(ABOUT).parquet(f"{path}/about").first().asDict()


def vectors_of(nodes: DataFrame) -> DataFrame:
    """The indexed vectors, a row for each id."""
    return nodes.select(F.explode("members").alias("doc_id"), "vec", "shard")


def update(spark: SparkSession, path: str, vectors: DataFrame | None = None, gone: DataFrame | None = None) -> None:
    """Adds vectors(doc_id, vec), which replace those of the same id, and removes gone(doc_id); only their shards are built anew.

    The whole index is built anew where a vector is longer than all before, so that the extra coordinate would not fit, and
    where the shards have come to hold twice their size.
    """
    nodes, about = opened(spark, path)
    empty = spark.createDataFrame([], "doc_id bigint, vec array<double>")
    new = written(_own(vectors) if vectors is not None else empty, "new-vectors")
    named = new.select("doc_id")
    if gone is not None:
        named = named.unionByName(gone.select(F.col("doc_id").cast("bigint").alias("doc_id")))
    named = written(named.where("doc_id is not null").distinct(), "named")
    n, longest = _longest(new)
    if longest > about["longest"] or (nodes.agg(F.sum(F.size("members"))).first()[0] or 0) + n > 2 * about["shards"] * about["shard_size"]:
        old = written(vectors_of(nodes).join(named, "doc_id", "left_anti").select("doc_id", "vec"), "old-vectors")
        return build(old.unionByName(new), path, about["links"], about["shard_size"])
    shard = shard_of(F.col("doc_id"), about["shards"])
    touched = [r[0] for r in named.select(shard.alias("shard")).distinct().collect()]  # numbers of shards
    old = vectors_of(nodes.where(F.col("shard").isin(touched))).join(named, "doc_id", "left_anti").select("doc_id", "vec")
    made = written(_shards(old.unionByName(new), about["shards"], about["links"], about["longest"]), "shards")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/nodes")
    left = {r[0] for r in made.select("shard").distinct().collect()}
    for shard_no in sorted(set(touched) - left):  # all of a shard is gone: one file without rows stays in its folder
        made.limit(0).drop("shard").coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes/shard={shard_no}")


def fitted_width(graph: Graph, queries: np.ndarray, k: int, width: int) -> int:
    """The beam, `width` or that doubled, with which a sample of the queries finds RECALL of what brute force over the shard finds.

    Where vectors lie in tight groups, a narrow beam fills up with one wrong group and ends there.
    """
    sample, k = queries[:: -(-len(queries) // SAMPLE)], min(k, len(graph.points))
    least = -np.partition(-(sample @ graph.points[:, :-1].T), k - 1, axis=1)[:, k - 1]
    while width < len(graph.points):
        found, _ = graph.search(sample, width)
        score = np.where(found >= 0, (graph.points[found, :-1] * sample[:, None, :]).sum(2), -np.inf)
        if np.minimum((score >= least[:, None] - 1e-9).sum(1), k).mean() >= RECALL * k:
            break
        width *= 2
    return width


def _finder(sent: Broadcast, longest: float, k: int, width: int, digits: int):
    """A shard's rows -> its k best for each query that was sent."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = sent.value
        graph = Graph.of(pdf, longest)
        beam = fitted_width(graph, vectors, k, width)
        rows = []
        for at in range(0, len(ids), 256):
            part = vectors[at : at + 256]
            found, compared = graph.search(part, beam)
            score = np.round((graph.points[found, :-1] * part[:, None, :]).sum(2), digits)
            for q in range(len(part)):
                best = sorted((-s, m) for p, s in zip(found[q].tolist(), score[q].tolist()) if p >= 0 for m in sorted(graph.members[p])[:k])[:k]
                rows += [(ids[at + q], m, -s, compared[q] if not r else 0) for r, (s, m) in enumerate(best)]
        return pd.DataFrame(rows, columns=["query_id", "doc_id", "score", "compared"])

    return find


def search(queries: DataFrame, path: str, k: int = 10, width: int = 64, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """queries(query_id, vec), a stated set, sent to the shards in blocks -> (query_id, rank, doc_id, score, compared).

    score is the inner product, ties by id; compared is how many distances a query took in all shards. A wider beam finds
    more; `width` is the least: a shard widens it until a sample of the queries finds RECALL of its best (fitted_width). Ids of equal vectors are all found. An empty index gives no row.
    """
    spark = queries.sparkSession
    nodes, about = opened(spark, path)
    longest, n = about["longest"], queries.count()
    width = max(width, k)
    blocks = -(-n // block)
    out = None
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas().sort_values("query_id")
        sent = spark.sparkContext.broadcast((own["query_id"].to_numpy(np.int64), np.array(own["vec"].tolist(), float)))
        made = nodes.groupBy("shard").applyInPandas(_finder(sent, longest, k, width, digits), "query_id bigint, doc_id bigint, score double, compared bigint")
        out = made if out is None else out.unionByName(made)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, doc_id bigint, score double, compared bigint")
    found = written(out, "found")
    took = found.groupBy("query_id").agg(F.sum("compared").alias("compared"))
    return top_k(found.drop("compared"), k).join(took, "query_id").select("query_id", "rank", "doc_id", "score", "compared")


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, recall): of each exact query's k best, those found."""
    hit = exact.where(F.col("rank") <= k).join(found.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg(F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("recall"))
