"""Token ids in a file format of Re-Pair grammars.

A shard's stream of ids is cut into blocks at document ends. In each block the most frequent pairs of
neighbouring symbols become new symbols, again and again, until no pair is frequent. A block keeps
its rules (two symbols each), the number of ids that each rule expands to, and the symbols left.
Documents never share a symbol, and with the expansion lengths any range of ids of any document is
found by a search in a running sum and decoded alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.common import bounded_batches, new_folder

BLOCK_IDS = 1 << 20
SLOTS = 20
CHARS = 4 << 20  # of texts that are encoded together
LIMIT = 1 << 16
#: A pair that occurs less often in a block isn't worth a rule.
MIN_COUNT = 12


def _slot(key: np.ndarray) -> np.ndarray:
    if key.dtype == np.uint64:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)
    return (key * np.uint32(2654435761)) >> np.uint32(32 - SLOTS)


def _pair_counts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs."""
    ordered = np.sort(key)
    starts = np.concatenate([[0], np.nonzero(ordered[1:] != ordered[:-1])[0] + 1])
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def compress(ids: np.ndarray, sizes: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids of documents of these sizes (none of 0) -> alphabet, rules (n, 2), symbols, symbols of each document.

    Symbols below the alphabet's length are its ids, the next ones the rules' in turn. Each round replaces all pairs
    at least a thirty-second as frequent as the most frequent one; where two such pairs overlap, the left one wins,
    and a pair that is left with under half of min_count waits, unless all are: then the most frequent one is replaced
    alone. It ends when no pair of neighbours occurs min_count times. Symbols are 16 bits wide while they fit, then 32.
    """
    (alphabet,) = np.nonzero(np.bincount(ids))
    dense = np.zeros(int(alphabet[-1]) + 1, np.uint32)
    dense[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    seq, last = dense[ids], np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    rules: list[np.ndarray] = []
    top = len(alphabet)
    while len(seq) > 1:
        kind, shift, room = (np.uint32, 16, LIMIT - top) if top < LIMIT else (np.uint64, 32, len(seq))
        key = seq[:-1].astype(kind) << kind(shift) | seq[1:].astype(kind)
        inner = ~last[:-1]
        if not inner.any():
            break
        names, counts = _pair_counts(key[inner])
        most = int(counts.max())
        if most < min_count:
            break
        (often,) = np.nonzero(counts >= max(min_count, most // 32))
        pairs = names[often][np.argsort(-counts[often], kind="stable")][:room]
        at, which = _places(key, inner, pairs)
        worth = np.bincount(which, minlength=len(pairs)) >= max(2, min_count // 2)
        if not worth.any():
            pairs, worth = pairs[:1], np.ones(1, bool)
            at, which = _places(key, inner, pairs)
        own = worth[which]
        at, which = at[own], which[own]
        number = (np.cumsum(worth) - 1 + top).astype(np.uint32)
        seq[at] = number[which]
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        made = pairs[worth]
        rules.append(np.stack([made >> kind(shift), made & kind((1 << shift) - 1)], 1).astype(np.uint32))
        top += len(made)
    every = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    width = np.uint16 if top <= LIMIT else np.uint32
    ends = np.nonzero(last)[0] + 1
    return alphabet.astype(np.uint32), every.astype(width), seq.astype(width), np.diff(ends, prepend=0)


def _places(key: np.ndarray, inner: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a pair is replaced, and which of `pairs`; of two in one slot of the look-up table the rarer waits a round."""
    table, slots = np.full(1 << SLOTS, -1, np.int32), _slot(pairs)
    table[slots[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
    which = table[_slot(key)]
    (at,) = np.nonzero((which >= 0) & inner)
    at = at[pairs[which[at]] == key[at]]
    place = np.arange(len(at), dtype=np.int32)
    run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))
    at = at[(place - run) & 1 == 0]
    return at, which[at]


def rule_lengths(rules: np.ndarray, letters: int) -> np.ndarray:
    """How many ids each rule expands to, with an alphabet of that many. A rule refers to earlier ones only."""
    out = np.zeros(len(rules), np.int64)
    for i, (a, b) in enumerate((rules.astype(np.int64) - letters).tolist()):
        out[i] = (1 if a < 0 else out[a]) + (1 if b < 0 else out[b])
    return out


@dataclass
class Block:
    """A grammar and the symbols of its documents."""

    alphabet: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    doc_symbols: np.ndarray

    def _length(self, symbols: np.ndarray) -> np.ndarray:
        s = symbols.astype(np.int64) - len(self.alphabet)
        return np.where(s < 0, 1, self.lengths[np.maximum(s, 0)]) if len(self.lengths) else np.ones(len(s), np.int64)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of these symbols: of each rule that occurs, the left half and then the right one, until none is left."""
        out = symbols.astype(np.int64)
        while len(self.rules):
            rule = out - len(self.alphabet)
            grown = rule >= 0
            if not grown.any():
                break
            at = np.cumsum(grown + 1) - grown - 1
            wide = np.empty(len(out) + int(grown.sum()), np.int64)
            wide[at] = np.where(grown, self.rules[np.maximum(rule, 0), 0], out)
            wide[at[grown] + 1] = self.rules[rule[grown], 1]
            out = wide
        return self.alphabet[out]

    def decode(self) -> np.ndarray:
        """All ids. Each symbol's ids are laid out once in a table, and then gathered."""
        every = np.arange(len(self.alphabet) + len(self.rules))
        size = self._length(every)
        flat = self.expand(every)
        starts = (np.cumsum(size) - size).astype(np.int32)
        sizes = size[self.symbols]
        before = np.cumsum(sizes, dtype=np.int32) - sizes.astype(np.int32)
        return flat[np.repeat(starts[self.symbols] - before, sizes) + np.arange(int(sizes.sum()), dtype=np.int32)]

    def slice(self, document: int, start: int, stop: int) -> np.ndarray:
        """ids start .. stop of one document; only the symbols that hold them are expanded."""
        ends = np.cumsum(self.doc_symbols)
        own = self.symbols[ends[document] - self.doc_symbols[document] : ends[document]]
        upto = np.concatenate([[0], np.cumsum(self._length(own))])
        start, stop = max(0, start), min(int(upto[-1]), stop)
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(upto, start, "right") - 1, np.searchsorted(upto, stop, "left")
        return self.expand(own[a:b])[start - upto[a] : stop - upto[a]]


BLOCKS = (
    "shard int, block int, before bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, "
    "doc_symbols array<bigint>, width int, alphabet binary, rules binary, lengths binary, symbols binary"
)


def _block_row(shard: int, block: int, before: int, docs: list, ids: np.ndarray, sizes: np.ndarray) -> dict:
    alphabet, rules, symbols, per_doc = compress(ids, sizes)
    lengths = rule_lengths(rules, len(alphabet))
    own = rules.dtype.newbyteorder("<")
    kept = {"alphabet": alphabet.astype("<u4"), "rules": rules.astype(own), "lengths": lengths.astype("<u4"), "symbols": symbols.astype(own)}
    head = {"shard": shard, "block": block, "before": before, "n_tokens": len(ids), "doc_ids": docs, "doc_tokens": sizes.tolist(), "doc_symbols": per_doc.tolist(), "width": own.itemsize}
    return head | {k: v.tobytes() for k, v in kept.items()}


def read_block(row: dict) -> Block:
    own = f"<u{row['width']}"
    alphabet, rules, lengths, symbols = (np.frombuffer(row[k], t) for k, t in (("alphabet", "<u4"), ("rules", own), ("lengths", "<u4"), ("symbols", own)))
    return Block(alphabet, rules.reshape(-1, 2).astype(np.int64), lengths.astype(np.int64), symbols, np.array(row["doc_symbols"], np.int64))


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of docs(doc_id, text) in ascending doc_id order (null first, equal ids by a hash of the text, then by text) to `folder`.

    Sorted by range into shards; a shard's stream is cut into blocks of about block_ids ids, so a task
    holds one block's documents. The files are Parquet with a row for each block: Spark's committer
    publishes them, and a lost executor's shard is written again.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from sparkwright.llm import encoding

    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, own = TaskContext.get().partitionId(), encoding.encoder(tokenizer, end_id)
        block = before = held = 0
        names: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_block_row(shard, block, before, names, np.concatenate(parts), np.concatenate(sizes))], schema)

        for b in batches:
            ids_of, texts, lengths = b.column(0).to_pylist(), b.column(1), pc.utf8_length(b.column(1)).to_pylist()
            at = 0
            while at < b.num_rows:
                upto, chars = at, 0
                while upto < b.num_rows and chars < CHARS:
                    chars += lengths[upto] or 0
                    upto += 1
                ids, n = own.encode(texts.slice(at, upto - at))
                names += ids_of[at:upto]
                parts.append(ids)
                sizes.append(n)
                held += len(ids)
                at = upto
                if held >= block_ids:
                    yield flush()
                    block, before, held, names, parts, sizes = block + 1, before + held, 0, [], [], []
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the hash deals the rows of one id, or of none, to many shards
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    ordered.mapInArrow(work, BLOCKS).write.option("compression", "zstd").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """What write_ids() wrote -> (doc_id, start, n_tokens, ids_crc32), from the decoded ids.

    start counts the ids of all documents before. The totals of the shards come to the driver: a
    number for each shuffle partition, whatever the number of documents.
    """
    from pyspark.sql.types import StructType

    blocks = spark.read.schema(StructType.fromDDL(BLOCKS)).parquet(folder)
    totals = {r[0]: r[1] for r in blocks.groupBy("shard").agg(F.sum("n_tokens")).collect()}
    starts, so_far = {}, 0
    for shard in sorted(totals):
        starts[shard] = so_far
        so_far += totals[shard]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(k)[i].as_py() for k in b.schema.names}
                ids = read_block(row).decode()
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                view = memoryview(ids.astype("<u4").view(np.uint8))
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                first = starts[row["shard"]] + row["before"]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(first + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_file(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, block_ids: int = BLOCK_IDS) -> DataFrame:
    """docs(doc_id, text, ...) -> one row for each input row: doc_id, start, n_tokens, ids_crc32, read back from the files.

    Encodes whole texts (null counts as empty), closes each with end_id and writes them to a new folder in
    the shared one. Repeated rows and ids each get their place, null ids come first, an empty table gives
    no row; further columns are ignored.
    """
    from sparkwright.llm import encoding

    folder = new_folder(docs.sparkSession, "token-ids")
    write_ids(docs, folder, tokenizer or encoding.default_path(), end_id, block_ids)
    return read_ids(docs.sparkSession, folder)
