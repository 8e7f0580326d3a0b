"""SimHash fingerprints and their links by Golay-code fuzzy keys.

A fingerprint of 64 bits falls into three segments of 21, 21 and 22 bits, each padded to the 23
bits of the perfect binary Golay code. Four differing bits leave one of two cases:

* some segment is equal: an exact key of that segment finds the pair;
* every segment differs, so two of them differ in one bit each. In a segment at distance one,
  one vector's own codeword (at distance 3 at most) lies within 4 of the other vector. A vector
  within 2 of its codeword has no other codeword within 4; one at distance 3 has five more. So the
  list of codewords within 4 of a vector, one or six, holds the other vector's own codeword.

A vector's keys are hence its three segments and, for each two segments, the pairs of codewords in
their lists; its address under each is the segment or the pair of its own codewords. Joining keys
to addresses loses no pair within four bits, and every pair found is verified by its bit count.

Keys of 21 to 24 bits would meet by chance where there are very many fingerprints. Beyond DEEP_FROM
of them each key is lengthened by what the bits that are left allow, and still no pair is lost:

* beside an equal segment the other two hold four errors or fewer. Either one of them holds one at
  most, and its codewords join the key, or both hold two: of three parts of each, one part is equal;
* beside two segments of one error each, the third holds one or two: one of its three parts is equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import bounded_batches, col, row_key, stored
from sparkwright.llm.components import components

SEGMENTS = ((0, 21), (21, 21), (42, 22))
GENERATOR = 0b101011100011  # of the (23, 12) Golay code
MAX_BITS = 4
#: From this many distinct fingerprints on, keys are longer; the links are the same.
DEEP_FROM = 1 << 22


def _remainder(word: np.ndarray) -> np.ndarray:
    """Of 23-bit words, as polynomials over GF(2), modulo the generator: 11 bits."""
    word = word.copy()
    for bit in range(22, 10, -1):
        word = np.where(word >> bit & 1, word ^ (GENERATOR << (bit - 11)), word)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: up to six error patterns of weight 4 or less, the lightest first, and their number."""
    bits = 1 << np.arange(23)
    patterns = [np.array([0])]
    for weight in range(1, 5):
        low = patterns[-1]
        grown = (low[:, None] | bits[None, :])[(low[:, None] < bits[None, :])]
        patterns.append(grown)
    every = np.concatenate(patterns)
    weights = np.repeat(np.arange(5), [len(p) for p in patterns])
    syndrome = _remainder(every)
    table, count, least = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64), np.full(2048, 9)
    order = np.lexsort((every, weights, syndrome))
    starts = np.searchsorted(syndrome[order], np.arange(2049))
    for s in range(2048):
        mine = order[starts[s] : starts[s + 1]]
        least[s] = weights[mine[0]]
        mine = mine[:6] if least[s] == 3 else mine[:1]
        table[s, : len(mine)], count[s] = every[mine], len(mine)
    return table, count


_CACHE: list = []


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices of the codewords within 4, the own one first, and how many of them count."""
    if not _CACHE:
        _CACHE.extend(_tables())
    table, count = _CACHE
    s = _remainder(segment.astype(np.int64))
    return (segment[:, None] ^ table[s]) >> 11, count[s]


def keys_of(prints: np.ndarray, deep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unsigned fingerprints: each one's keys with a mask of the real ones, and its addresses. The kind is in the top bits."""
    segments = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    coded = [codewords(s) for s in segments]
    lists = [c[0] for c in coded]
    real = [np.arange(6)[None, :] < c[1][:, None] for c in coded]
    parts = [np.stack([s & 127, s >> 7 & 127, s >> 14], 1) for s in segments]
    sure = np.ones((len(prints), 1), bool)
    keys: list[np.ndarray] = []
    mask: list[np.ndarray] = []
    address: list[np.ndarray] = []

    def add(*fields: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> None:
        """A kind of key of these fields: the values to ask for, which of them count, the values to be found at (one, or as many), and the bits."""
        asked, counts, found = np.zeros((len(prints), 1), np.int64), sure, np.zeros((len(prints), 1), np.int64)
        for values, some, own, bits in fields:
            asked = (asked[:, :, None] << bits | values[:, None, :]).reshape(len(prints), -1)
            counts = (counts[:, :, None] & some[:, None, :]).reshape(len(prints), -1)
            found = (found[:, :, None] << bits | own[:, None, :]).reshape(len(prints), -1)
        kind = len(keys) << 48
        keys.append(asked | kind)
        mask.append(counts)
        address.append(found | kind)

    exact = [(s[:, None], sure, s[:, None], 22) for s in segments]
    near = [(lists[i], real[i], lists[i][:, :1], 12) for i in range(3)]
    part = [[(p[:, [k]], sure, p[:, [k]], 8) for k in range(3)] for p in parts]
    for i in range(3):
        a, b = (j for j in range(3) if j != i)
        if deep:
            for j in (a, b):
                add(exact[i], near[j])
            for x in part[a]:
                for y in part[b]:
                    add(exact[i], x, y)
            for x in part[i]:
                add(near[a], near[b], x)
        else:
            add(exact[i])
            add(near[a], near[b])
    return np.concatenate(keys, 1), np.concatenate(mask, 1), np.concatenate(address, 1)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of one text: see simhash()."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, width: int = 4) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, k0, k1, k2, fp bigint: the 64 bits as a signed number); for k0 to k2 see row_key().

    Lower-cases A-Z, takes words between ASCII white space and their shingles of `width` words with
    repeats (fewer words: the whole sequence; none, or null: fingerprint 0); a bit is set where over
    half of the shingles' XXH64 (seed 42) have it. Reads two columns, keeps one text in memory.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(4)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(fps)], ["doc_id", "k0", "k1", "k2", "fp"])

    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *row_key(), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(prints, "doc_id bigint, k0 boolean, k1 bigint, k2 bigint, fp bigint")


def fuzzy_keys(prints: DataFrame, deep: bool = False) -> DataFrame:
    """(fp) -> (fp, keys array<bigint>, addresses array<bigint>)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                fps = part.column(0).to_numpy(zero_copy_only=False)
                every, real, address = keys_of(fps.view("<u8"), deep)
                offsets = np.concatenate([[0], np.cumsum(real.sum(1))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(offsets, pa.array(every[real]))
                own = pa.ListArray.from_arrays(np.arange(0, address.size + 1, address.shape[1], dtype=np.int32), pa.array(address.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), keys, own], ["fp", "keys", "addresses"])

    return prints.select("fp").mapInArrow(keyed, "fp bigint, keys array<bigint>, addresses array<bigint>")


def links(prints: DataFrame, max_bits: int = MAX_BITS, deep_from: int = DEEP_FROM) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) whose components are those of all pairs within
    max_bits (4 at most) bits. Not all pairs are returned: see below.

    First each address sends its vectors to its smallest vector where they are that near, which is
    linear. What these links join is one class; the second join keeps only pairs between classes, so
    a large group of near copies, which lies in one class by then, gives no quadratic output.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys lose no pair up to 4 bits only")
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= max_bits
    keyed = stored(fuzzy_keys(prints, prints.count() >= deep_from), "keys")
    address = keyed.select("fp", F.explode("addresses").alias("key"))
    least = address.groupBy("key").agg(F.min("fp").alias("least"))
    star = address.join(least, "key").where((F.col("fp") != F.col("least")) & near("fp", "least")).select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    star = stored(star, "star")
    class_of = components(star)
    named = keyed.join(class_of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("root", "fp")).drop("root")
    named = stored(named, "named")
    left = named.select(F.col("fp").alias("a"), F.col("class").alias("ca"), F.explode("keys").alias("key"))
    right = named.select(F.col("fp").alias("b"), F.col("class").alias("cb"), F.explode("addresses").alias("key"))
    across = left.join(right, "key").where((F.col("ca") != F.col("cb")) & near("a", "b"))
    # classes joined once are joined: one edge for each two of them is enough
    bridge = across.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    return star.unionByName(bridge)


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fingerprint, component_id), one row for each input row.

    component_id is the smallest doc_id that a chain of links reaches, itself included; equal
    fingerprints link at distance 0, those of empty texts too. Null texts count as empty; a null
    doc_id keeps its row and never names a component (alone, its component_id is null); repeated
    rows stay; further columns are ignored; an empty table gives an empty one.
    """
    marks = stored(simhash(docs, width), "simhash")
    kinds = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "kinds")
    joined = _rooted(kinds, max_bits)
    named = joined.join(joined.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    out = marks.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(kinds: DataFrame, max_bits: int) -> DataFrame:
    """kinds, a row for each distinct fp, with `root`, the smallest fingerprint of its component."""
    class_of = components(links(kinds, max_bits)).withColumnRenamed("node", "fp")
    return kinds.join(class_of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_first(docs: DataFrame, width: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """docs without its near-duplicates: of each component one row stays, that of the smallest doc_id (null after
    all others), of equal ids that of the smallest XXH64 of the text, of rows equal in both any one. All columns are
    kept. Which row stays is found on ids and hashes alone; the documents move once, to meet the answer.
    """
    marks = stored(simhash(docs, width), "simhash")
    order = F.min(F.struct("k0", "k1", "k2"))
    kinds = stored(marks.groupBy("fp").agg(order.alias("first")), "kinds")
    best = _rooted(kinds, max_bits).groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    names = [f"c{i}" for i in range(len(docs.columns))]
    keys = docs.select(*(col(c).alias(n) for c, n in zip(docs.columns, names)), *(k.alias(f"_{n}") for k, n in zip(row_key(), ("k0", "k1", "k2"))))
    kept = keys.join(best, (F.col("_k0") == F.col("k0")) & (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left_semi")
    return kept.dropDuplicates(["_k0", "_k1", "_k2"]).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))
