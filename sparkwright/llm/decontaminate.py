"""Benchmark passages in training documents: rare n-gram seeds that no alignment can miss, then Smith-Waterman alignment.

The items are the stated query set; the documents are scanned against them in place and never
shuffled. Items go to the executors in blocks of bounded size. An alignment that scores at least the
threshold loses a bounded number of points, and each point can break a bounded number of an item's
n-grams; so for each item the longest n is taken of which some n-grams are sure to stay whole. A first
scan counts the items' n-grams over all documents. If `least` of an item's n-grams stay whole, one of
its rarest (all - least + 1) does: those are its seeds. The second scan joins documents with items on
seeds alone; only for the items so found the other n-grams are looked at, and wherever enough of them
stand close together, the item is aligned with the words around.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import bounded_batches, col, row_key

N = 4
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.6
#: Characters of items that are sent to the executors at once; what a task holds of a document grows with them.
BLOCK_CHARS = 2_000_000
FOUND = "doc_id bigint, k0 boolean, k1 bigint, k2 bigint, item bigint, score double, first_word bigint, last_word bigint"
_CLEAN = bytes(32 if chr(i) in '!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~' else i for i in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words between ASCII white space and punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_CLEAN).split()


class _Known(dict):
    def __missing__(self, key: bytes) -> int:
        return 0


@dataclass
class Items:
    """A block of items: their ids, their words as numbers from 1, and the number of each word."""

    ids: list
    words: list[np.ndarray]
    numbers: dict[bytes, int]

    @staticmethod
    def of(ids: list, texts: list[str | None]) -> Items:
        numbers: dict[bytes, int] = {}
        own = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in words_of(t)], np.int64) for t in texts]
        some = [i for i, w in enumerate(own) if len(w)]
        return Items([ids[i] for i in some], [own[i] for i in some], numbers)

    def grams(self, ns: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of each item's n-grams, its own n of `ns`, and of each place the number of its n-gram, its item and its position."""
        found = [gram_hashes(w, n) for w, n in zip(self.words, ns)]
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(found)), [len(h) for h in found])
        position = np.concatenate([np.arange(len(h)) for h in found]) if found else np.zeros(0, np.int64)
        hashes, which = np.unique(every, return_inverse=True)
        return hashes, which, item, position


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, of their number too."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    w, h = words.astype(np.uint64), np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ w[k : len(w) - n + 1 + k]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def least_grams(length: int, threshold: float, n: int) -> tuple[int, int, int]:
    """Of an item of that many words: n, how many of its n-grams an alignment of at least the threshold leaves whole, and how many points it can lose.

    An inserted word costs one point and breaks n - 1 n-grams; a changed or missing one costs three and breaks
    n, one cut off at an end costs two and breaks one. Where even one word could lie between any two, n is 1.
    """
    points = max(0, min(MATCH * length - 1, int(np.floor(MATCH * length * (1 - threshold) + 1e-9))))
    for k in range(min(n, length), 1, -1):
        least = length - (k - 1) * (1 + points)
        if least > 0:
            return k, least, points
    return 1, length - points // MATCH, points


class Finder:
    """Looks up n-grams of documents: hashes are sorted; a bit table turns most others away."""

    def __init__(self, hashes: np.ndarray, sizes: list[int]):
        self.hashes, self.sizes = hashes, sizes
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions, and which hash stands there."""
        at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.sizes:
            h = gram_hashes(words, n)
            (may,) = np.nonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
            if len(may) and len(self.hashes):
                k = np.minimum(np.searchsorted(self.hashes, h[may]), len(self.hashes) - 1)
                hit = self.hashes[k] == h[may]
                at.append(may[hit])
                which.append(k[hit])
        return np.concatenate(at), np.concatenate(which)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: the best local score of the item in the text, and the end (exclusive) in the text. One row of cells for each item word."""
    ramp = np.arange(len(text) + 1) * -GAP
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for w in item:
        new = np.maximum(row + GAP, 0)
        np.maximum(new[1:], row[:-1] + np.where(text == w, MATCH, MISMATCH), out=new[1:])
        row = np.maximum.accumulate(new + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def numbered(text: str | None, numbers: dict) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def dense(at: np.ndarray, of: np.ndarray, least: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Of places sorted by item and position: whether the item's `least` next ones, itself the first, begin within `reach` words."""
    last = np.arange(len(at)) + least[of] - 1
    fits = last < len(at)
    last = np.minimum(last, len(at) - 1)
    return fits & (of[last] == of) & (at[last] - at <= reach[of])


def regions(at: np.ndarray, position: np.ndarray, length: int, slack: int, n_words: int) -> list[tuple[int, int]]:
    """Where the item may stand for n-grams at these document and item positions; overlapping regions are one."""
    a = np.sort(at - position - slack)
    out: list[tuple[int, int]] = []
    for s in a.tolist():
        s, e = max(0, s), min(n_words, s + length + 2 * slack)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text) -> (doc_id, item_id, score, first_word, last_word):
    a row for each document row and item whose alignment scores at least the threshold.

    score is the best local alignment's share of the item's score against itself (match 2, mismatch and gap
    -1), 1 for a whole copy; the words are those of the alignment, from 0. Null and empty texts on either
    side match nothing; items with equal texts or ids each count; repeated document rows repeat; null ids are
    kept; other columns are ignored; an empty benchmark gives no row.
    """
    named = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.xxhash64(F.col("text").cast("string")).alias("item"))
    found = scan(docs, benchmark, n, threshold, block_chars)
    return found.join(named, "item").select("doc_id", "item_id", "score", "first_word", "last_word")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """As contaminated(), with the row's key k0, k1, k2 (see row_key()) and the XXH64 of the item's text: equal items
    are aligned once, however often one is repeated, so a block's bound holds.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *row_key(), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    out = spark.createDataFrame([], FOUND)
    hashed = items.withColumn("item", F.xxhash64("text"))
    for k in range(blocks):
        own = hashed.where(F.pmod("item", F.lit(blocks)) == k).toArrow().sort_by([("item", "ascending"), ("text", "ascending")])
        found = Items.of(own["item"].to_pylist(), own["text"].to_pylist())
        if found.ids:
            out = out.unionByName(_block(docs, found, n, threshold))
    return out


@dataclass
class Seeds:
    """Of a block's n-grams: sorted hashes and their lengths; of each item (in CSR form, by hash) its n-grams and positions;
    of each hash (in CSR form) the items that it is a seed of; of each item `least`, the reach and the slack of a match."""

    hashes: np.ndarray
    sizes: list[int]
    item_starts: np.ndarray
    which: np.ndarray
    position: np.ndarray
    seed_starts: np.ndarray
    seed_items: np.ndarray
    least: np.ndarray
    reach: np.ndarray
    slack: np.ndarray


def rarest(counts: np.ndarray, item: np.ndarray, which: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Of each item's places (item, which n-gram) all but `least` - 1, those whose n-grams are the rarest: whether a place is a seed."""
    order = np.lexsort((which, counts[which], item))
    rank = np.empty(len(item), np.int64)
    rank[order] = np.arange(len(item)) - np.searchsorted(item[order], item[order])
    return rank <= np.bincount(item, minlength=len(least))[item] - least[item]


def _corpus_counts(docs: DataFrame, items: Items, hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How often each n-gram stands in all documents: a number for each n-gram of the block comes to the driver."""
    sent = docs.sparkSession.sparkContext.broadcast((items.numbers, hashes, sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, hashes, sizes = sent.value
        known, finder = _Known(numbers), Finder(hashes, sizes)
        out = np.zeros(len(hashes), np.int64)
        for b in batches:
            for t in b.column(0):
                out += np.bincount(finder.find(numbered(t.as_py(), known))[1], minlength=len(hashes))
        (some,) = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(out[some], pa.int64())], ["gram", "n"])

    found = docs.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(hashes), np.int64)
    out[found["gram"].to_numpy()] = found["n"].to_numpy()
    return out


def seeds_of(items: Items, n: int, threshold: float, count) -> Seeds:
    """count: from sorted hashes and their lengths to how often each stands in the documents."""
    own = [least_grams(len(w), threshold, n) for w in items.words]
    ns, least, slack = (np.array(x) for x in zip(*own))
    hashes, which, item, position = items.grams(ns.tolist())
    sizes = np.unique(ns).tolist()
    order = np.lexsort((which, item))
    which, item, position = which[order], item[order], position[order]
    seed = rarest(count(hashes, sizes), item, which, least)
    pairs = np.unique(which[seed] * len(least) + item[seed])
    starts = lambda x, m: np.searchsorted(x, np.arange(m + 1))
    reach = np.array([len(w) for w in items.words]) + slack - ns
    return Seeds(hashes, sizes, starts(item, len(least)), which, position, starts(pairs // len(least), len(hashes)), pairs % len(least), least, reach, slack)


def candidates(seeds: Seeds, gram: np.ndarray) -> np.ndarray:
    """The items of which one of these n-grams is a seed."""
    (own,) = np.nonzero(np.diff(seeds.seed_starts)[gram])
    found = np.unique(gram[own])
    return np.unique(np.concatenate([seeds.seed_items[seeds.seed_starts[g] : seeds.seed_starts[g + 1]] for g in found])) if len(found) else found


def places(seeds: Seeds, i: int, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of item i: where its n-grams stand among these (in the document, in the item), where enough of them are close."""
    if len(at) < seeds.least[i]:
        return at[:0], at[:0]
    a, b = seeds.item_starts[i : i + 2]
    which, position = seeds.which[a:b], seeds.position[a:b]
    low, high = np.searchsorted(which, gram), np.searchsorted(which, gram, "right")
    many = high - low
    own = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    at, where = np.repeat(at, many), position[own]
    order = np.argsort(at, kind="stable")
    at, where = at[order], where[order]
    keep = dense(at, np.zeros(len(at), np.int64), seeds.least[i : i + 1], seeds.reach[i : i + 1])
    return at[keep], where[keep]


def _block(docs: DataFrame, items: Items, n: int, threshold: float) -> DataFrame:
    seeds = seeds_of(items, n, threshold, lambda hashes, sizes: _corpus_counts(docs, items, hashes, sizes))
    sent = docs.sparkSession.sparkContext.broadcast((items, seeds))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seeds = sent.value
        known, finder = _Known(items.numbers), Finder(seeds.hashes, seeds.sizes)
        done: dict[tuple, tuple[int, int, int]] = {}

        def best(i: int, text: np.ndarray) -> tuple[int, int, int]:
            """Score, start and end of item i's alignment; what was aligned before is looked up."""
            key = (i, text.tobytes())
            if key not in done:
                if len(done) > 20_000:
                    done.clear()
                score, end = align(items.words[i], text)
                start = end
                if score >= threshold * MATCH * len(items.words[i]):
                    start = end - align(items.words[i][::-1], text[:end][::-1])[1]
                done[key] = (score, start, end)
            return done[key]

        for b in batches:
            rows: list[tuple] = []
            for of_row, t in enumerate(b.column(4)):
                words = numbered(t.as_py(), known)
                at, gram = finder.find(words)
                for i in candidates(seeds, gram).tolist():
                    near, where = places(seeds, i, at, gram)
                    if not len(near):
                        continue
                    length = len(items.words[i])
                    found = [(*best(i, words[a:e]), a) for a, e in regions(near, where, length, int(seeds.slack[i]), len(words))]
                    score, start, end, a = max(found, key=lambda x: (x[0], -x[3]))
                    if score >= threshold * MATCH * length:
                        rows.append((of_row, items.ids[i], score / (MATCH * length), a + start, a + end - 1))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            of_row, *found = (pa.array(c, k) for c, k in zip(cols, kinds))
            yield pa.RecordBatch.from_arrays([*(c.take(of_row) for c in b.columns[:4]), *found], ["doc_id", "k0", "k1", "k2", "item", "score", "first_word", "last_word"])

    return docs.mapInArrow(find, FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that contaminated() finds, each judged by its own text: rows that share an id are told
    apart, null ids are no exception. All columns are kept.
    """
    found = scan(docs, benchmark, threshold=threshold).select("k0", "k1", "k2").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    keys = docs.select(*(col(c).alias(n) for c, n in zip(docs.columns, names)), *(k.alias(f"_{n}") for k, n in zip(row_key(), ("k0", "k1", "k2"))))
    kept = keys.join(found, (F.col("_k0") == F.col("k0")) & (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left_anti")
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))
