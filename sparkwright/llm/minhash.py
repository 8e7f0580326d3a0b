"""MinHash near-duplicates by an inverted join of signature coordinates.

A document's signature has COORDINATES minima; each is posted under its coordinate and value. Two documents at
or above the similarity agree in at least `least_matches` coordinates but for a chance of MISS, so pairs are
found by counting collisions, in three steps that never merge the long lists:

* skip: a value that one document alone has can't collide. What is left of a signature are its shared values;
  a document with fewer of them than the threshold has no partner and goes, whatever else it shares;
* prefix: of the n shared values of a document, rarest first, at least one of the first n - threshold + 1 is
  among any threshold of them. Only these are joined, so the most frequent values are left out;
* count: the collisions of each pair found are counted over all of both signatures, long lists by looking up.

Pairs above the threshold are confirmed on the full sets. Documents of one set are one entry throughout. A large
group of near copies would still meet in all pairs, so rounds come first that are linear in the lists: each list
compares its members with one of them, its centre, and of each two classes (what links have joined so far, at first a document) the
one pair that agrees most is confirmed. The first centres are those whose values are the most frequent (among copies with
edits of their own, that is what they were copied from), later ones are drawn from outside a list's largest class.
When a round finds nothing, or after ROUNDS, the join looks at the lists in which classes still meet, and at all
their pairs of different classes; long lists are dealt in blocks. A pair must also pass a bound of its full sets:
each set has BITS parities of its shingles by hash, and sets differ in at least as many shingles as their parities do.
Copies whose edits have little in common pass the counts of a signature, but not this. Rounds and bits save work
and change no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import bounded_batches, discard, row_key, stored
from sparkwright.llm.components import components

WIDTH = 4
PERCENT = 80
COORDINATES = 64
#: The chance that a pair just at the similarity agrees in fewer coordinates than asked for.
MISS = 1e-7
SEED = 42
#: Members of a list that one task pairs with the whole list.
LIST_BLOCK = 1024
#: Linear rounds at most before the join of lists.
ROUNDS = 3
#: Parities of a set, a multiple of 64.
BITS = 1024
_MARKS = "doc_id bigint, k0 boolean, k1 bigint, k2 bigint, n bigint, digest binary, signature array<bigint>"


@cache
def least_matches(coordinates: int, percent: int, miss: float = MISS) -> int:
    """The largest number of agreeing coordinates, 1 at least, that a pair of this similarity falls short of with at most this chance."""
    p, below = percent / 100, 0.0
    for t in range(coordinates):
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return max(1, t)
    return coordinates


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z in lower case; fewer words: of the whole sequence; none: empty.

    A shingle's hash mixes its words' XXH64 in their order, and their number.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    width = min(width, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        h = (h ^ own[k : len(h) + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signature(hashes: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """The minima of n permutations of a set that isn't empty: the coordinate in the top bits, 57 or more of the value below."""
    times, plus = _permutations(n)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        np.minimum(least, (part[None, :] * times[:, None] + plus[:, None]).min(1), out=least)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    return (least >> bits | np.arange(n, dtype=np.uint64) << (np.uint64(64) - bits)).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """BITS bits, as whole numbers of 64: how many of the set's hashes fall to a bit, modulo 2."""
    odd = np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def marks(docs: DataFrame, width: int = WIDTH, n: int = COORDINATES) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, k0, k1, k2: see row_key(), n, digest, signature), of the set of the text's shingles; the last two null where it is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sets = [shingles(t.as_py(), width) for t in part.column(4)]
                digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
                signed = pa.array([signature(s, n) if len(s) else None for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([len(s) for s in sets], pa.int64()), digests, signed], ["doc_id", "k0", "k1", "k2", "n", "digest", "signature"])

    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *row_key(), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(work, _MARKS)


def full_sets(docs: DataFrame, entries: DataFrame, width: int = WIDTH) -> DataFrame:
    """entries(id, k0, k1, k2) -> (id, hashes array<bigint>, bits array<bigint>: see parities()) of their texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(t.as_py(), width) for t in part.column(1)]
                kinds = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in sets], kinds), pa.array([parities(s) for s in sets], kinds)], ["id", "hashes", "bits"])

    own = docs.select(*row_key(), F.col("text").cast("string").alias("text"))
    found = own.join(entries.select("id", "k0", "k1", "k2"), ["k0", "k1", "k2"]).select("id", "text")
    return found.mapInArrow(work, "id bigint, hashes array<bigint>, bits array<bigint>").dropDuplicates(["id"])


def _similar(n: str, m: str, both: str, percent: int):
    return 100 * F.col(both) >= percent * (F.col(n) + F.col(m) - F.col(both))


def _near_in_size(n: str, m: str, percent: int):
    """Sets whose sizes differ more can't be that similar."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _near_in_bits(n: str, m: str, a: str, b: str, percent: int):
    """Sets that differ in more shingles can't be that similar."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)))
    return (100 + percent) * differ <= (100 - percent) * (F.col(n) + F.col(m))


def counted(pairs: DataFrame, entries: DataFrame, least: int, percent: int) -> DataFrame:
    """pairs(a, b) of entries(id, n, shared array) (and more columns) whose collisions reach the threshold, with n, m and matches."""
    left = entries.select(F.col("id").alias("a"), "n", F.col("bits").alias("ba"), F.col("shared").alias("sa"))
    right = entries.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("bb"), F.col("shared").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").where(_near_in_size("n", "m", percent) & _near_in_bits("n", "m", "ba", "bb", percent))
    return both.withColumn("matches", F.size(F.array_intersect("sa", "sb"))).where(F.col("matches") >= least).drop("ba", "bb", "sa", "sb")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b, n, m, ...) whose full sets are similar enough. pairs should be a table: where it is small it is sent to the sets."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    right = sets.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    both = left.join(pairs, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("ha", "hb")))
    return both.where(_similar("n", "m", "both", percent)).select("a", "b")


def shared_values(kinds: DataFrame, least: int) -> DataFrame:
    """kinds(id, n, signature, ...) -> (id, n, shared, frequency): the values of a signature that others have too, rarest first, and
    how many entries have them in sum; without the entries that have fewer than `least`."""
    posted = kinds.select("id", F.explode("signature").alias("value"))
    often = posted.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = posted.join(often, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own")).where(F.size("own") >= least)
    return own.select("id", F.col("own.value").alias("shared"), F.aggregate("own", F.lit(0).cast("bigint"), lambda s, x: s + x["df"]).alias("frequency"))


def links(docs: DataFrame, kinds: DataFrame, width: int = WIDTH, percent: int = PERCENT, coordinates: int = COORDINATES, list_block: int = LIST_BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """docs and their distinct sets, kinds(id, k0, k1, k2, n, signature) -> edges (a, b) whose components are those of all similar pairs."""
    least = least_matches(coordinates, percent)
    live = stored(shared_values(kinds, least).join(kinds.select("id", "k0", "k1", "k2", "n"), "id"), "live")
    sets = stored(full_sets(docs, live, width), "sets")
    entries = stored(live.select("id", "n", "shared", "frequency").join(sets.select("id", "bits"), "id"), "shared")
    discard(live)
    prefix = stored(entries.select("id", "n", "frequency", F.explode(F.slice("shared", F.lit(1), F.size("shared") - least + 1)).alias("value")), "prefix")

    class_of, edges, tried = None, None, None
    for k in range(rounds):
        posted = _by_class(prefix, class_of)
        best = stored(_best_of_centres(posted, entries, tried, k, least, percent), "best")
        new = stored(confirmed(best, sets, percent), "confirmed")
        if new.isEmpty():
            break
        edges = new if edges is None else edges.unionByName(new)
        tried = best.select("a", "b") if tried is None else tried.unionByName(best.select("a", "b"))
        class_of = stored(components(edges).select(F.col("node").alias("id"), F.col("root").alias("class")), "classes")

    posted = stored(_by_class(prefix, class_of), "posted")
    mixed = posted.groupBy("value").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("many")).where("low <> high")
    mixed = mixed.select("value", F.ceil(F.col("many") / list_block).cast("int").alias("blocks"))
    dealt = posted.join(mixed, "value").join(entries.select("id", "bits"), "id")
    left = dealt.select("value", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.col("id").alias("a"), "n", F.col("class").alias("ca"), F.col("bits").alias("ba"))
    right = dealt.select("value", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("class").alias("cb"), F.col("bits").alias("bb"))
    across = left.join(right, ["value", "block"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _near_in_size("n", "m", percent) & _near_in_bits("n", "m", "ba", "bb", percent))
    found = stored(counted(stored(across.select("a", "b").distinct(), "across"), entries, least, percent), "found")
    bridge = confirmed(found, sets, percent)
    out = stored(bridge if edges is None else edges.unionByName(bridge), "similar")
    for table in (sets, entries, prefix, posted, found):
        discard(table)
    return out


def _by_class(prefix: DataFrame, class_of: DataFrame | None) -> DataFrame:
    if class_of is None:
        return prefix.withColumn("class", F.col("id"))
    return prefix.join(class_of, "id", "left").withColumn("class", F.coalesce("class", "id"))


def _best_of_centres(posted: DataFrame, entries: DataFrame, tried: DataFrame | None, k: int, least: int, percent: int) -> DataFrame:
    """Of each two classes the pair (a, b, n, m) that agrees most, among those of members a with the centres b of their lists in this round."""
    rank = F.struct("frequency", "id", "class") if k == 0 else F.struct(F.xxhash64("id", F.lit(k)).alias("frequency"), "id", "class")
    by_class = posted.groupBy("value", "class").agg(F.count("*").alias("many"), F.max(rank).alias("top"))
    largest = by_class.groupBy("value").agg(F.max(F.struct("many", "class")).alias("big"), F.count("*").alias("classes")).where("classes > 1").select("value", F.col("big.class").alias("big"))
    outside = F.lit(True) if k == 0 else F.col("class") != F.col("big")
    centre = by_class.join(largest, "value").where(outside).groupBy("value").agg(F.max("top").alias("c")).select("value", F.col("c.id").alias("b"), F.col("c.class").alias("cb"))
    sent = posted.join(centre, "value").where(F.col("class") != F.col("cb")).select(F.col("id").alias("a"), "class", "b", "cb").distinct()
    if tried is not None:
        sent = sent.join(tried, ["a", "b"], "left_anti")
    best = counted(sent, entries, least, percent).groupBy("class", "cb").agg(F.max(F.struct("matches", "a", "b", "n", "m")).alias("c"))
    return best.select("c.a", "c.b", "c.n", "c.m")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, coordinates: int = COORDINATES, list_block: int = LIST_BLOCK) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), one row for each input row.

    A text's set is its distinct shingles of `width` words between ASCII white space, A-Z in lower case; with fewer words the
    whole sequence. Texts link where percent * union <= 100 * intersection; component_id is the smallest doc_id that a chain
    of links reaches, itself included. Null and empty texts have empty sets and link with nothing; a null doc_id keeps its
    row and never names a component (alone, its component_id is null, and it is kept); repeated rows stay; further columns
    are ignored; an empty table gives an empty one.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and 100 at most")
    own = stored(marks(docs, width, coordinates), "minhash")
    first = own.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.min(F.struct("k0", "k1", "k2")).alias("k"))
    first = stored(first.withColumn("id", F.monotonically_increasing_id()), "kinds")
    named = first.select("id", "digest", "k.k0", "k.k1", "k.k2")
    signed = own.select("k0", "k1", "k2", "n", "signature").join(named.drop("digest"), ["k0", "k1", "k2"])
    kinds = stored(signed.dropDuplicates(["id"]).select("id", "k0", "k1", "k2", "n", "signature"), "signatures")
    edges = links(docs, kinds, width, percent, coordinates, list_block)
    root = components(edges).select(F.col("node").alias("id"), "root")
    rooted = first.join(root, "id", "left").select("digest", "first", F.coalesce("root", "id").alias("root"))
    component = rooted.groupBy("root").agg(F.min("first").alias("component"))
    found = own.select("doc_id", "n", "digest").join(rooted.join(component, "root").select("digest", "component"), "digest", "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
pairs AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN comp ON n.doc_id = comp.a"""
