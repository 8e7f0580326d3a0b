"""The Merkle manifest and the MinHash links, each against a plain form."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import merkle, minhash

from .helpers import DOCS, PLAIN, awkward, documents, empty


# Merkle manifest


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def plain_path(levels, i, arity):
    """Of each level below the root: the place in the run, and the run's others."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[i - i % arity : i - i % arity + arity]
        out.append((i % arity, run[: i % arity] + run[i % arity + 1 :]))
        i //= arity
    return out


def plain_fold(node, path):
    for place, others in path:
        node = h(others[:place] + [node] + others[place:])
    return node


def plain_manifest(rows, arity):
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((first(r["doc_id"]), plain_leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[1] for x in sorted(groups[g], key=lambda x: x[:2])], arity) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        for i, (_, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            path = plain_path(trees[g], i, arity) + plain_path(top, k, arity)
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = plain_fold(plain_leaf(r, 1) if changed else leaf, path)
            out.append((r["doc_id"], leaf, trees[g][-1][0], top[-1][0], h([x for _, o in path for x in o]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity, height", [(2, 10), (2, 1), (2, 2), (3, 2), (7, 1)])
def test_manifest_of_odd_rows_is_the_plain_one(spark, arity, height):
    docs = awkward(spark)
    assert sorted(map(tuple, merkle.manifest(docs.repartition(5), arity, height).collect()), key=str) == plain_manifest([r.asDict() for r in docs.collect()], arity)


@pytest.mark.parametrize("sizes", [[1], [2, 1, 3], [130, 1, 64, 0, 65, 33], [517]])
def test_manifest_of_runs_over_many_partitions(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randrange(10**6), f"text {i}", None if not k else f"l{k}", "s", i, 0.0, "", "", 0) for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, merkle.manifest(docs, 2, 3).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == plain_manifest([r.asDict() for r in docs.collect()], 2)


def test_repeated_rows_are_leaves_each_and_no_rows_give_none(spark):
    rows = [(1, "same", "en", "s", 4, 0.0, "", "", 0)] * 300
    got = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    assert len(got) == 300 and len({r.leaf for r in got}) == 1 and all(r.verified for r in got)
    assert merkle.manifest(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        merkle.proofs(empty(spark), arity=1)


def test_subtrees_fill_a_run():
    for total in range(1, 40):
        for start in range(total):
            for end in range(start + 1, total + 1):
                found = list(merkle.tiles(start, end, total, 2, 3))
                assert [t[2] for t in found] == [start, *(t[3] for t in found[:-1])] and found[-1][3] == end
                assert all(a == i * 2**k and b == min(a + 2**k, total) and k <= 3 for k, i, a, b in found)


def test_proofs_are_those_of_the_whole_trees(spark):
    found = merkle.proofs(awkward(spark)).collect()
    assert all(merkle.fold(merkle.fold(bytes(r.leaf), r.idx, r.total, bytes(r.path)), r.group_idx, r.groups, bytes(r.group_path)) == bytes(r.root) for r in found)
    assert all(r.other is None for r in found) and {r.groups for r in found} == {2}
    wrong = found[0]
    assert merkle.fold(merkle.fold(b"\0" * 32, wrong.idx, wrong.total, bytes(wrong.path)), wrong.group_idx, wrong.groups, bytes(wrong.group_path)) != bytes(wrong.root)


# MinHash near-dedup


def plain_set(text, width=4):
    words = [w for w in "".join(" " if c in "\t\n\x0b\f\r " else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_classes(rows, percent=80, width=4):
    """(doc_id, n, component, kept) by all pairs."""
    sets = [plain_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    least = {r: min((x for x in own if x is not None), default=None) for r, own in ids.items()}
    return sorted(((doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def near_copies(seed, originals=12, copies=9):
    """Texts with edits of their own, chains of edits, passages that many share, short ones, and copies."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage = words(60)
    out = []
    for k in range(originals):
        base = words(rng.choice([5, 30, 120, 400]))
        if k % 3 == 0:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for c in range(copies):
            own = list(base)
            for _ in range(round(len(own) * rng.choice([0, 0.01, 0.02, 0.03, 0.06]))):
                own[rng.randrange(len(own))] = rng.choice("xyz") + str(rng.randrange(10**6))
            out.append(" ".join(own))
            if c % 4 == 3:
                base = own
    out += [" ".join(passage), " ".join(passage[:2]), "one", "One\t", "two words", ""]
    rng.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("seed, list_block", [(0, 1024), (1, 3)])
def test_components_are_those_of_all_pairs(spark, seed, list_block):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, minhash.near_duplicates(docs, list_block=list_block).collect()), key=str)
    assert got == plain_classes(rows)
    assert len({r[2] for r in got}) < len(rows)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in documents()]
    got = sorted(map(tuple, minhash.near_duplicates(awkward(spark)).collect()), key=str)
    want = [(d, n, c, k if d is not None else c is None) for d, n, c, k in plain_classes(rows)]
    # rows without a set link with nothing, not even by a null id
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(empty(spark), percent=0)


@pytest.mark.parametrize("percent, width", [(50, 3), (100, 4), (90, 5)])
def test_other_similarities_and_widths(spark, percent, width):
    rows = near_copies(7, 6, 6)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, minhash.near_duplicates(docs, width, percent).collect()), key=str) == plain_classes(rows, percent, width)


def test_a_large_group_of_copies_with_edits_makes_no_quadratic_join(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        own = list(base)
        for _ in range(4):
            own[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash.near_duplicates(docs).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    both, one = rng.integers(0, 1 << 63, 8000, np.uint64), rng.integers(0, 1 << 63, 2000, np.uint64)
    a, b = minhash.signature(np.unique(both), 512), minhash.signature(np.unique(np.concatenate([both, one])), 512)
    assert abs((a == b).mean() - 0.8) < 0.08 and len(set(a.tolist())) == 512
    assert minhash.least_matches(64, 80) == 33 and minhash.least_matches(64, 100) == 64 and minhash.least_matches(8, 80, 1e-3) == 2


def test_fields_are_hashed_as_told(spark):
    row = spark.createDataFrame([("é", None, 12)], "a string, b string, c int").select(F.concat(*[merkle.field(F.col(c)) for c in "abc"])).first()
    assert row[0] == "2:é-2:12" and PLAIN
