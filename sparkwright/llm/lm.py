"""Scores of whole texts: a word model over the whole training part, and the attention model.

The training part is fixed by a hash of the id. Word counts are taken over all of it and grow with
it. A text's frequent words, the FREQUENT ones with the largest counts or about so, are looked up in
a table sent to the executors; all others meet their counts in a join. Subword ids are made once and written to the shared folder; their
counts over the whole training part give the classes and the shares within them. The attention weights
start from a fit to windows drawn from all of it, about TRAIN_IDS ids; then every window of the training
part is learned from once, in rounds: each task goes on from the same weights over its own windows, and
the weights' mean, by windows, begins the next round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm import encoding
from sparkwright.llm.attention import INPUTS, LENGTH, STATES, Model, Vocabulary, go_on, train
from sparkwright.llm.common import ascii_lower, bounded_batches, stored

FREQUENT = 150_000
TRAIN_IDS = 1_500_000
#: Rates of the rounds over the whole training part; each round has a share of the texts.
RATES = (0.003, 0.002, 0.001, 0.0003)
BATCH = 64
SCALE = 1 << 24  # weights are summed as whole numbers, so that their order doesn't matter
CHARS = 1 << 20  # of texts that are encoded together
PIECES = 250_000  # that a process keeps the ids of; beyond them it starts anew
END = "\n"  # no word holds white space, so this stands for the end token


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def word_counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) of the training part -> (word, c), the end token among them."""
    words = docs.select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    words = words.groupBy("word").agg(F.count("*").alias("c")).select(ascii_lower(F.col("word")).alias("word"), "c")  # few are left to lower-case
    ends = docs.agg(F.count("*").alias("c")).where("c > 0").select(F.lit(END).alias("word"), "c")
    return words.groupBy("word").agg(F.sum("c").alias("c")).unionByName(ends)


def _first_pass(docs: DataFrame, frequent: dict[str, int], whole: int, distinct: int, tokenizer: str) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, known, base, rare, ids): `base` and `known` without the rare words."""
    spark = docs.sparkSession
    shift = np.log10(whole + distinct + 1)
    sent = spark.sparkContext.broadcast({w: float(np.log10(c + 1) - shift) for w, c in frequent.items()})
    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, rare array<struct<word:string,n:int>>, ids binary"
    fields = [pa.field("word", pa.string()), pa.field("n", pa.int32())]

    def rows_of(part: pa.RecordBatch, own: encoding.WordEncoder, values: dict[str, float]) -> pa.RecordBatch:
        n = part.num_rows
        ids, sizes, words, which, counts = own.encode_words(pc.ascii_lower(pc.fill_null(part.column(3), "")))
        names = words.to_numpy(zero_copy_only=False).tolist()
        value = np.array(list(map(values.get, names)), float)  # nan for the rare ones
        doc = np.repeat(np.arange(n), counts)
        if "" in names:  # before a text's first word, if white space stands there
            real = which != names.index("")
            doc, which = doc[real], which[real]
        tokens = np.bincount(doc, minlength=n) + 1
        each = value[which]
        rare = np.isnan(each)
        known = tokens - 1 - np.bincount(doc[rare], minlength=n)
        base = np.bincount(doc[~rare], each[~rare], minlength=n).astype(float)
        pair, times = np.unique(doc[rare] * len(names) + which[rare], return_counts=True)
        of, word = np.divmod(pair, max(1, len(names)))
        names, many = words.take(pa.array(word)), np.bincount(of, minlength=n)
        if END in values:
            known, base = known + 1, base + values[END]
        else:  # the end is rare: one for each text, after its other words
            at = np.cumsum(many)
            names = pa.array(np.insert(names.to_numpy(zero_copy_only=False), at, END), pa.string())
            times, many = np.insert(times, at, 1), many + 1
        pairs = pa.StructArray.from_arrays([names, pa.array(times, pa.int32())], fields=fields)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pairs)
        flat, ends = ids.astype("<u2").tobytes(), 2 * np.cumsum(sizes)
        binary = pa.array([flat[x:y] for x, y in zip((ends - 2 * sizes).tolist(), ends.tolist())], pa.binary())
        cols = [pa.array(tokens), pa.array(known), pa.array(base), lists, binary]
        return pa.RecordBatch.from_arrays([*part.columns[:3], *cols], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "rare", "ids"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding.encoder(tokenizer, max_pieces=PIECES)
        for b in batches:
            at, lengths = 0, pc.fill_null(pc.utf8_length(b.column(3)), 0).to_pylist()
            while at < b.num_rows:
                upto, chars = at, 0
                while upto < b.num_rows and chars < CHARS:
                    chars += lengths[upto]
                    upto += 1
                yield rows_of(b.slice(at, upto - at), own, sent.value)
                at = upto
            pa.default_memory_pool().release_unused()

    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    return stored(own.mapInArrow(work, schema), "first-pass")


def _training_ids(batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[np.ndarray]:
    """The texts' ids one after the other, an end after each, about a million at once."""
    held: list[bytes] = []
    size, end = 0, np.array([end_id], "<u2").tobytes()
    for b in batches:
        for x in b.column(0):
            held += (x.as_py(), end)
            size += len(held[-2])
            if size > 1 << 21:
                yield np.frombuffer(b"".join(held), "<u2").astype(np.int64)
                held, size = [], 0
    if held:
        yield np.frombuffer(b"".join(held), "<u2").astype(np.int64)


def _summed(first: DataFrame, cells: int, end_id: int, cell_of) -> np.ndarray:
    """How often each cell stands in the whole training part. One number for each cell, whatever the corpus."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(cells, np.int64)
        for ids in _training_ids(batches, end_id):
            found = cell_of(ids)
            sums += np.bincount(found[found >= 0], minlength=cells)
        (some,) = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["cell", "n"])

    counted = first.where("not held_out").select("ids").mapInArrow(work, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    return out


def _pieces(first: DataFrame, end_id: int, total: int, most: int) -> list[np.ndarray]:
    """Pieces of LENGTH + 1 ids, drawn from all of the training part by a hash of the id and the place, `most` ids or about so."""
    share = min(1.0, most / max(1, total))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, rows = [], []
            for h, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.concatenate([[end_id], np.frombuffer(x.as_py(), "<u2"), [end_id]]).astype("<u2")
                starts = np.arange(0, len(ids) - 1, LENGTH)
                for s in starts[np.random.default_rng(h & 0xFFFFFFFF).random(len(starts)) < share].tolist():
                    out.append(ids[s : s + LENGTH + 1].tobytes())
                    rows.append(h ^ s)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(out, pa.binary())], ["h", "piece"])

    drawn = first.where("not held_out").select(F.xxhash64("doc_id", "ids").alias("h"), "ids").mapInArrow(work, "h bigint, piece binary").toArrow()
    drawn = drawn.sort_by([("h", "ascending"), ("piece", "ascending")])
    return [np.frombuffer(x.as_py(), "<u2").astype(np.int64) for x in drawn["piece"]]


def _batches(batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[list[np.ndarray]]:
    """All windows of the texts, BATCH of them at once."""
    held: list[np.ndarray] = []
    for b in batches:
        for x in b.column(0):
            ids = np.concatenate([[end_id], np.frombuffer(x.as_py(), "<u2"), [end_id]])
            for s in range(0, len(ids) - 1, LENGTH):
                held.append(ids[s : s + LENGTH + 1])
                if len(held) == BATCH:
                    yield held
                    held = []
    if held:
        yield held


def _refined(first: DataFrame, model: Model, end_id: int, rates: tuple[float, ...] = RATES) -> tuple[Model, int]:
    """The model after every window of the training part, and how many windows there were."""
    spark, names, seen = first.sparkSession, list(model.w), 0
    texts = first.where("not held_out").select("ids", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(len(rates))).alias("round"))
    for k, rate in enumerate(rates):
        sent = spark.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Model(sent.value.vocabulary)
            own.w = {name: w.copy() for name, w in sent.value.w.items()}
            n = go_on(own, _batches(batches, end_id), rate)
            if n:
                flat = np.concatenate([own.w[name].ravel() for name in names]).astype(float)
                sums = np.append(np.rint(flat * SCALE).astype(np.int64) * n, n)  # the last cell counts windows
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["cell", "n"])

        found = texts.where(F.col("round") == k).select("ids").mapInArrow(work, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        if not found.num_rows:
            continue
        sums = found.sort_by("cell")["n"].to_numpy()
        seen += int(sums[-1])
        flat, at = (sums[:-1] / sums[-1] / SCALE).astype(np.float32), 0
        after = Model(model.vocabulary)
        for name in names:
            after.w[name] = flat[at : at + model.w[name].size].reshape(model.w[name].shape)
            at += model.w[name].size
        model = after
    return model, seen


def score_texts(docs: DataFrame, tokenizer: str | None = None, train_ids: int = TRAIN_IDS, steps: int = 2500, rates: tuple[float, ...] = RATES) -> DataFrame:
    """docs(doc_id, text, ...) -> one row for each input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score sums log10((c + 1) / (N + V + 1)) over the lower-case words between ASCII white space and one
    end; score is the attention model's log10 probability of the text's subword ids and an end (its vocabulary
    lower-cases all letters and drops white space). Null texts count as empty, null ids as an empty id when
    folds are told apart; repeated rows keep their rows; other columns are ignored; an empty table gives no row.
    Without a training part N and V are 0 and the attention model is uniform over classes.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or encoding.default_path()
    if encoding.encoder(tokenizer).library.get_vocab_size(True) > 1 << 16:
        raise ValueError("ids are kept in 16 bits; the vocabulary has more")
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = stored(word_counts(docs.where(~held_out(F.col("doc_id")))), "word-counts")
    whole, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the count that about FREQUENT words exceed; then those that do, no more of them than that
    least = counts.agg(F.percentile_approx("c", max(0.0, 1 - FREQUENT / distinct), 100_000)).first()[0] if distinct > FREQUENT else 0
    frequent = {w: c for w, c in counts.where(F.col("c") > least).toLocalIterator()} if distinct else {}
    first = _first_pass(docs, frequent, whole, distinct, tokenizer)
    del frequent

    end_id = int(encoding.encoder(tokenizer).library.token_to_id("<|endoftext|>"))
    sums = _summed(first, end_id + 1, end_id, lambda ids: ids)
    vocabulary = Vocabulary.of(sums)
    pair = vocabulary.pair
    # texts follow each other with an end between, so each text's first id comes after an end
    vocabulary.learn_pairs(_summed(first, STATES * INPUTS, end_id, lambda ids: pair(np.concatenate([[end_id], ids[:-1]]), ids)))
    pieces = _pieces(first, end_id, int(sums.sum()), train_ids)
    model, _ = _refined(first, train(vocabulary, pieces, steps), end_id, rates)
    sent = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            at, rows = 0, b.column(6)
            while at < b.num_rows:
                texts, held = [], 0
                while at + len(texts) < b.num_rows and held < 1 << 17:
                    ids = np.frombuffer(rows[at + len(texts)].as_py(), "<u2").astype(np.int32)
                    texts.append(np.append(ids, np.int32(end_id)))
                    held += len(texts[-1])
                score = pa.array(model.log10(texts, end_id))
                part = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:6], score], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score"])
                at += len(texts)

    scored = first.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "ids")
    scored = scored.mapInArrow(work, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double")
    rare = first.select("row", F.inline("rare")).join(counts, "word", "left")
    shift = float(np.log10(whole + distinct + 1))
    rare = rare.groupBy("row").agg(
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - F.lit(shift))).alias("more"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"),
    )
    out = scored.join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(int(whole)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
