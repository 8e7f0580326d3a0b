import collections
import textwrap

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkwright.llm import decontaminate, licenses, lm, simhash, toxicity
from sparkwright.llm.components import components

from .helpers import PLAIN, awkward, documents, empty, is_held_out


# Components and SimHash


def plain_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)] + [tuple(map(int, e)) for e in rng.integers(200, 400, (120, 2)) if e[0] != e[1]]
    found = components(spark.createDataFrame(edges + edges[:5], "a bigint, b bigint"))
    assert {r.node: r.root for r in found.collect()} == plain_components([e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("deep", [False, True])
@pytest.mark.parametrize("bits", range(5))
def test_keys_lose_no_pair_within_four_bits(bits, deep):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, bits, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    keys, real, _ = simhash.keys_of(x, deep)
    _, _, address = simhash.keys_of(y, deep)
    assert ((keys[:, :, None] == address[:, None, :]) & real[:, :, None]).any((1, 2)).all()


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    sums = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b, s in enumerate(sums) if 2 * s > len(grams))


def test_near_duplicates_by_brute_force(spark):
    rows = documents()
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(awkward(spark)).collect()), key=str)
    prints = [plain_fingerprint(r[1]) for r in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = plain_components(edges)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[roots[i]] = min(least.get(roots[i], r[0]), r[0])
    want = sorted(((r[0], f"{prints[i]:016x}", least.get(roots[i])) for i, r in enumerate(rows)), key=str)
    assert got == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("deep_from", [0, 1 << 40])
def test_links_by_brute_force(spark, deep_from):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(6):
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                s ^= 1 << b
            prints.add(s & ((1 << 63) - 1))
    prints = sorted(prints)
    edges = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = plain_components(edges)
    want = {prints[i]: prints[r] for i, r in roots.items()}
    found = components(simhash.links(spark.createDataFrame([(x,) for x in prints], "fp bigint"), deep_from=deep_from))
    assert {r.node: r.root for r in found.collect()} == want


def test_one_row_of_each_group_stays(spark):
    docs = awkward(spark)
    rows = [tuple(r) for r in docs.collect()]
    prints = [plain_fingerprint(r[1]) for r in rows]
    roots = {i: i for i in range(len(rows))} | plain_components([(i, j) for i in range(len(rows)) for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4])
    first = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) ^ 1 << 63)
        first[roots[i]] = min(first.get(roots[i], (key, r)), (key, r), key=lambda x: x[0])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(str(r) for _, r in first.values())


# Toxicity


def toxic_corpus(spark):
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = list(rng.choice(words, 60))
        if toxic:
            for at in rng.integers(0, 60, 5):
                text[at] = ["idiot", "moron"][int(at) % 2]
        rows.append((i, " ".join(text), "s"))
        if i < 400:
            labels.append((i, int(i % 10 != 0), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, severity string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_severity_on_rows_held_out(spark):
    docs, labels = toxic_corpus(spark)
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == 600 and all(out[i].toxic == (i % 5 == 0) for i in range(400, 600))
    bad, good = ([out[i].severity for i in range(400, 600) if (i % 5 == 0) == t] for t in (True, False))
    assert min(bad) > max(good)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 480
    again = {r.doc_id: r.severity for r in toxicity.toxicity(docs, labels).collect()}
    assert again == {i: r.severity for i, r in out.items()}


def test_severity_of_awkward_rows(spark):
    _, labels = toxic_corpus(spark)
    none = labels.limit(0)
    out = toxicity.toxicity(awkward(spark), none)
    assert out.count() == len(documents()) and not any(r.toxic for r in out.collect())
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    odd = spark.createDataFrame([(1, None, 1), (None, 1, 1), (2, 0, None), (4, 0, 1), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(awkward(spark), odd).count() == len(documents())


def test_gradient_of_the_ordinal_loss():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 8)).astype(np.int32) for _ in range(200)]
    grades = np.array([2 if 3 in r else 1 if 5 in r else 0 for r in rows])
    m = toxicity.fit(rows, grades, 3, l1=1e-4, min_rows=1)
    s = np.array([m.weights[r].sum() for r in rows])
    assert (m.probabilities(s).argmax(1) == grades).mean() > 0.97
    assert np.allclose(m.probabilities(s).sum(1), 1) and (np.diff(m.thresholds) > 0).all()


# Licenses


def test_phrases_and_notices(spark):
    texts = ["MIT License MIT license, the mit\nlicense", "Released under the license of MIT", "Licensed under CC BY-NC 4.0. and cc by", None, "", "gnu general public licenses", "This work is licensed under gnu general public license version three",
             "Ünder the MIT-License", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert got[0] == (7, 3, 0, 5, "mit", "mit", 1.0)
    assert got[1] == (6, 0, None, None, "", "mit", 1.0)
    assert got[2] == (10, 2, 2, 8, "cc-by", "cc-by,cc-by-nc-4.0", 1.0)
    assert got[3] == got[4] == (0, 0, None, None, "", "", 0.0)
    assert got[5] == (4, 0, None, None, "", "", 0.0)
    assert got[6][1:5] == (1, 5, 5, "gpl") and "gpl-3.0" in got[6][5]
    assert got[7][1:5] == (1, 2, 2, "mit")


def test_containment_by_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = sorted({w for _, t in licenses.NOTICES for w in licenses.notice_words(t)}) + ["zz", "yy", "xx"]
    lines = [" ".join(rng.choice(pool, int(n))) for n in rng.integers(3, 40, 150)]
    lines += [" ".join(w for w in licenses.notice_words(t) if rng.random() > 0.15) for _, t in licenses.NOTICES for _ in range(6)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 3])) for i in range(0, len(lines), 3)], "doc_id bigint, text string")
    got = {r.doc_id: (set(filter(None, r.labels.split(","))), set(r.base_labels.split(",")), r.score, r.n_base) for r in licenses.scan(docs).collect()}
    for i in range(0, len(lines), 3):
        best, labels = 0.0, set()
        words = " ".join(lines[i : i + 3]).split()
        for label, t in licenses.NOTICES:
            want = set(licenses.notice_words(t))
            wide = licenses.SPREAD * len(want)
            blocks = [set(line.split()) for line in lines[i : i + 3]] + [set(words[k : k + wide]) for k in range(len(words))]
            c = max(len(want & held) / len(want) for held in blocks)
            if c >= 0.8:
                best, labels = max(best, c), labels | {label}
        assert labels <= got[i][0] and got[i][0] - got[i][1] <= labels
        assert got[i][3] > 0 or got[i][2] == pytest.approx(best)


@pytest.mark.parametrize("columns", [20, 28, 40, 80])
@pytest.mark.parametrize("between", ["\n", "\n\n", "\n// ", "\n *\n * "])
def test_wrapped_notices(spark, columns, between):
    """A notice is found however its lines break, with blank lines and comment marks; its words spread over long lines are none."""
    texts = [f"{PLAIN}\n" + between.join(textwrap.wrap(t, columns)) + f"\n{PLAIN}" for _, t in licenses.NOTICES]
    far = ["\n".join(f"{w} {PLAIN} {' '.join(f'x{i}y{k}' for k in range(40))}" for i, w in enumerate(licenses.notice_words(t))) for _, t in licenses.NOTICES]
    docs = spark.createDataFrame(list(enumerate([*texts, *far])), "doc_id bigint, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(docs).collect()}
    for i, (label, _) in enumerate(licenses.NOTICES):
        assert label in got[i] and got[len(texts) + i] == [""]


def test_words_by_case(spark):
    """Only A-Z are lower-cased: a Kelvin sign is no k, though the quick pass takes it for one."""
    docs = spark.createDataFrame([(1, "MIT LICENSE \u0130x"), (2, "gnu general public licens\u212a apache license"), (3, "\u212acc by K")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.base_labels) for r in licenses.scan(docs).collect()}
    assert got == {1: (3, 1, "mit"), 2: (6, 1, "apache"), 3: (3, 0, "")}


def test_license_rows_and_native_plan(spark, monkeypatch):
    want = sorted(map(str, licenses.scan(awkward(spark)).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_DOCS", 0)
    assert sorted(map(str, licenses.scan(awkward(spark)).collect())) == want
    out = licenses.scan(awkward(spark))
    assert out.count() == len(documents()) and licenses.scan(empty(spark)).count() == 0
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


# Decontamination


def test_copies_whole_and_edited(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    items = [" ".join(word() for _ in range(30)) for _ in range(8)]
    clean = [" ".join(word() for _ in range(200)) for _ in range(40)]
    edited = items[1].split()
    for at in (6, 14, 22):
        edited[at] = "changed"
    edited.insert(10, "inserted")
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0] + " " + items[0].upper() + "! " + clean[1]), (101, clean[2] + " " + " ".join(edited)), (102, " ".join(items[2].split()[:8])), (103, items[3]), (103, items[3]), (None, items[4]), (104, None), (105, "")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "")], "item_id bigint, text string")
    want = {(100, 0), (101, 1), (103, 3), (None, 4)}
    for block in (10**9, 200):
        got = decontaminate.contaminated(docs, bench, block_chars=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == 5
    one = next(r for r in got if r.doc_id == 100)
    assert (one.score, one.first_word, one.last_word) == (1.0, 200, 229)
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} - {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {100, 101, 103, None}
    # rows that share an id, or have none, are judged each by its own text; names may hold dots
    odd = docs.unionByName(spark.createDataFrame([(100, clean[5], 1.0), (None, clean[6], 1.0)], docs.schema)).withColumnRenamed("score", "item_id.x`y")
    left = decontaminate.drop_contaminated(odd, bench)
    assert left.columns == odd.columns and {(r[0], r[1]) for r in left.collect() if r[0] in (100, None)} == {(100, clean[5]), (None, clean[6])}
    # repeated items each count
    twice = decontaminate.contaminated(docs, bench.unionByName(bench.where("item_id = 0")).unionByName(bench.where("item_id = 3").selectExpr("cast(null as bigint) item_id", "text")))
    assert sorted((r.doc_id, r.item_id) for r in twice.collect() if r.doc_id == 100) == [(100, 0)] * 2
    assert [r.item_id for r in twice.collect() if r.doc_id == 103].count(None) == 2
    assert decontaminate.contaminated(empty(spark), bench).count() == 0 and decontaminate.contaminated(awkward(spark), bench.limit(0)).count() == 0


def test_alignment_by_plain_cells():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(1, 6, rng.integers(1, 12)), rng.integers(1, 6, rng.integers(1, 25))
        cells = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                cells[i, j] = max(0, cells[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), cells[i - 1, j] - 1, cells[i, j - 1] - 1)
        score, end = decontaminate.align(a, b)
        assert score == cells.max() and (score == 0 or cells[:, end].max() == score)


def test_common_grams_still_seed(spark):
    """A passage that most documents share is found in all of them."""
    docs = spark.createDataFrame([(i, f"{PLAIN} tail{i}") for i in range(50)], "doc_id bigint, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(1, PLAIN)], "item_id bigint, text string"))
    assert got.count() == 50


@pytest.mark.parametrize("length", [6, 12, 23, 40])
def test_copies_edited_all_over(spark, length):
    """Every 5th and every 6th word replaced, a word put in after every other one, the last word changed: all that reach the threshold by plain alignment are found."""
    rng = np.random.default_rng(length)
    item = [f"w{x}" for x in rng.permutation(1000)[:length]]
    rows = [[w if (i + 1) % k else f"new{i}" for i, w in enumerate(item)] for k in (3, 4, 5, 6)]
    rows += [[x for i, w in enumerate(item) for x in ([w, f"in{i}"] if i % 2 else [w])], item[:-1] + ["new"], [x for i, w in enumerate(item) for x in ([w, f"in{i}"] if i % 5 != 4 else [w])]]
    numbers = {w: i + 1 for i, w in enumerate(item)}
    number = lambda words: np.array([numbers.get(w, 0) for w in words])
    want = {i: decontaminate.align(number(item), number(r))[0] / (2 * length) for i, r in enumerate(rows)}
    assert min(want[2], want[3], want[4], want[5]) >= 0.6
    docs = spark.createDataFrame([(i, " ".join(["before"] * 9 + r + ["after"] * 9)) for i, r in enumerate(rows)], "doc_id bigint, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert {r.doc_id: r.score for r in got.collect()} == {i: s for i, s in want.items() if s >= 0.6}


def test_no_alignment_lacks_its_grams():
    """Random texts of few words: whatever reaches the threshold has the n-grams that are asked for."""
    rng = np.random.default_rng(5)
    hits = 0
    for _ in range(4000):
        item = rng.permutation(40)[: rng.integers(1, 12)] + 1
        text = [x for w in item for x in ([w] if rng.random() < 0.85 else [] if rng.random() < 0.5 else [0]) + [0] * int(rng.random() < 0.4)]
        text = np.array(text, np.int64)
        for threshold in (0.4, 0.6, 0.8, 1.0):
            if not len(text) or decontaminate.align(item, text)[0] < threshold * 2 * len(item):
                continue
            n, least, points = decontaminate.least_grams(len(item), threshold, 4)
            own = decontaminate.gram_hashes(item, n)
            at = np.array([k for k, h in enumerate(decontaminate.gram_hashes(text, n)) if h in own], np.int64)
            found = decontaminate.dense(at, np.zeros(len(at), np.int64), np.array([least]), np.array([len(item) + points - n]))
            assert found.any()
            hits += 1
    assert hits > 1000


# Language model


def test_seeds_are_the_rarest_and_none_is_missed():
    """Each item's seeds are its rarest n-grams, and every text that an item aligns with at the threshold has one of them."""
    rng = np.random.default_rng(12)
    words = [f"w{int(400 * x**2)}" for x in rng.random(4000)]
    pick = lambda n: [words[int(k)] for k in rng.integers(0, len(words), n)]
    texts = [" ".join(pick(int(n))) for n in (1, 2, 3, 8, 20, 45, 90)]
    items = decontaminate.Items.of(list(range(len(texts))), texts)
    known = decontaminate._Known(items.numbers)
    docs = []
    for _ in range(150):
        own = texts[int(rng.integers(0, len(texts)))].split()
        for _ in range(int(rng.integers(0, 1 + len(own) // 4))):
            k = int(rng.integers(0, len(own)))
            own[k : k + int(rng.integers(0, 2))] = pick(int(rng.integers(0, 2)))
            own = own or ["w1"]
        docs.append(" ".join(pick(30) + own + pick(30)))
    numbers = [decontaminate.numbered(t, known) for t in docs]
    counted = []

    def count(hashes, sizes):
        finder = decontaminate.Finder(hashes, sizes)
        counted.append(sum(np.bincount(finder.find(w)[1], minlength=len(hashes)) for w in numbers))
        return counted[0]

    seeds = decontaminate.seeds_of(items, 4, 0.6, count)
    for i in range(len(texts)):
        own = seeds.which[seeds.item_starts[i] : seeds.item_starts[i + 1]]
        chosen = {g for g in range(len(seeds.hashes)) if i in seeds.seed_items[seeds.seed_starts[g] : seeds.seed_starts[g + 1]]}
        others = [counted[0][g] for g in own if g not in chosen]
        assert len(others) < seeds.least[i] and max(counted[0][g] for g in chosen) <= min(others, default=1 << 60)
    finder, found = decontaminate.Finder(seeds.hashes, seeds.sizes), 0
    for w in numbers:
        at, gram = finder.find(w)
        near = {i for i in decontaminate.candidates(seeds, gram).tolist() if len(decontaminate.places(seeds, i, at, gram)[0])}
        for i, item in enumerate(items.words):
            if decontaminate.align(item, w)[0] >= 0.6 * 2 * len(item):
                found += 1
                assert i in near
    assert found > 100


@pytest.mark.parametrize("frequent", [100_000, 5])
def test_base_scores_by_hand(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = documents()
    out = lm.score_texts(awkward(spark), steps=5)
    counts = collections.Counter()
    for r in rows:
        if not is_held_out(r[0]):
            counts.update([*(r[1] or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        words = [*(r[1] or "").encode().lower().split(), b"\n"]
        want.append((str(r[0]), is_held_out(r[0]), len(words), sum(counts[w] > 0 for w in words), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words), 5)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out.collect()]
    assert sorted(got) == sorted(want)


def test_model_learns_order_and_is_a_distribution():
    from sparkwright.llm.attention import INPUTS, LENGTH, STATES, Vocabulary, train, windows

    rng = np.random.default_rng(0)
    text = np.array([(7 * i) % 50 for i in range(4000)])
    counts = np.bincount(text, minlength=60)
    vocabulary = Vocabulary.of(counts, 20, 5)
    pieces = [text[s : s + LENGTH + 1] for s in range(0, 3900, LENGTH)]
    model = train(vocabulary, pieces, 200)
    ordered, shuffled = model.log10([text[:500]], 59)[0], model.log10([rng.permutation(text[:500])], 59)[0]
    assert ordered > shuffled + 50
    pair = vocabulary.pair(np.concatenate([[59], text[:-1]]), text)
    vocabulary.learn_pairs(np.bincount(pair[pair >= 0], minlength=STATES * INPUTS))
    for before in (0, 7, 59):
        share = 10 ** vocabulary.within(np.full(60, before), np.arange(60))
        assert np.allclose(np.bincount(vocabulary.classes, share), 1, atol=1e-5)
    parts = [text[:33], text[:1], np.zeros(0, int), text[:200]]
    assert np.allclose(model.log10(parts, 59), [model.log10([p], 59)[0] for p in parts], atol=1e-4)
    for n in (1, 31, 32, 33, 56, 57, 200):
        starts, first = windows(n)
        seen = [s + i for s, f in zip(starts, first) for i in range(f, LENGTH) if s + i < n]
        assert sorted(seen) == list(range(n))


def test_the_model_keeps_its_size():
    from sparkwright.llm.attention import DIM, Model, Vocabulary

    vocabulary = Vocabulary.of(np.arange(5000)[::-1])
    assert vocabulary.n_classes == 128 and Model(vocabulary).w["A"].shape == (DIM, 32)


def test_gradients_of_the_model():
    from sparkwright.llm.attention import LENGTH, Model, Vocabulary

    rng = np.random.default_rng(1)
    vocabulary = Vocabulary.of(rng.integers(1, 50, 30), 10, 4)
    model = Model(vocabulary)
    model.w = {k: x.astype(float) for k, x in model.w.items()}
    inputs, classes, weight = rng.integers(0, 30, (3, LENGTH)), rng.integers(0, vocabulary.n_classes, (3, LENGTH)), np.ones((3, LENGTH))
    _, g = model.gradients(inputs, classes, weight)
    for k in model.w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        values = []
        for d in (1e-3, -1e-3):
            model.w[k][at] += d
            values.append(model.gradients(inputs, classes, weight)[0])
            model.w[k][at] -= d
        assert (values[0] - values[1]) / 2e-3 == pytest.approx(g[k][at], rel=0.05, abs=1e-4)


def test_all_training_text_is_learned_from(spark):
    """With almost nothing drawn for the start, the rounds over all texts still teach the order of words; every window counts once."""
    from sparkwright.llm.attention import LENGTH, Vocabulary, train

    docs = spark.createDataFrame([(i, " ".join(PLAIN.split()[i % 7 :] * 120)) for i in range(300)], "doc_id bigint, text string").coalesce(1)
    total = lambda **more: lm.score_texts(docs, train_ids=64, steps=2, **more).where("held_out").agg(F.sum("score")).first()[0]
    assert total() > total(rates=()) + 100
    rng = np.random.default_rng(1)
    sizes = [0, 1, 30, 31, 32, 63, 64, 500]
    rows = [(i, i == 2, rng.integers(0, 90, n).astype("<u2").tobytes()) for i, n in enumerate(sizes)]
    first = spark.createDataFrame(rows, "doc_id bigint, held_out boolean, ids binary")
    _, seen = lm._refined(first, train(Vocabulary.of(np.arange(100)), []), 99)
    assert seen == sum(-(-(n + 1) // LENGTH) for i, n in enumerate(sizes) if i != 2)


def test_scores_of_no_rows(spark):
    assert lm.score_texts(empty(spark), steps=2).count() == 0
    only = awkward(spark).where(lm.held_out(F.col("doc_id")))
    assert {r.train_tokens for r in lm.score_texts(only, steps=2).collect()} == {0}


def test_the_first_pass_keeps_a_bounded_number_of_pieces():
    from sparkwright.llm import encoding

    some = encoding.encoder(encoding.default_path(), max_pieces=lm.PIECES)
    assert some.max_pieces == lm.PIECES < encoding.encoder(encoding.default_path()).max_pieces
    few, texts = encoding.WordEncoder(encoding.default_path(), max_pieces=20), [f"word{i}, and other{i}" for i in range(200)]
    for t in texts:
        few.encode([t])
        assert few.encode([t])[0].tolist() == some.encode([t])[0].tolist() and len(few.pieces) < 40
