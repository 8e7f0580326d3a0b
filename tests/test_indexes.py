"""The kept indexes (proximity graph, inverted file, block-max postings) and the fitted embedder, against exact search."""

import collections
import os
import random

import numpy as np
import pytest
from measure import shuffled_bytes, shuffled_rows
from pyspark.sql import functions as F

from sparkwright.operators import blockmax, dense, hnsw, lsa, sparse


def vectors(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "doc_id bigint, vec array<double>")


def asked(df):
    return df.withColumnRenamed("doc_id", "query_id")


def pairs(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


def clouds(seed, n=1500, d=24, centres=30):
    """Vectors about centres, of different lengths, with copies."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(centres, d))[rng.integers(0, centres, n)] + 0.5 * rng.normal(size=(n, d))
    v *= rng.uniform(0.5, 2, (n, 1))
    v[100:140] = v[7]
    return list(enumerate(v))


# Proximity graph


@pytest.mark.parametrize("shard_size", [10_000, 400])
def test_graph_finds_what_exact_search_finds(spark, tmp_path, shard_size):
    df = vectors(spark, clouds(0))
    hnsw.build(df, str(tmp_path), shard_size=shard_size)
    queries = asked(df.where("doc_id % 10 = 0"))
    found = hnsw.search(queries, str(tmp_path), 10, 48).cache()
    exact = dense.inner_product_top_k(queries, df, 10)
    recall = hnsw.recall(found, exact, 10).agg(F.avg("recall")).first()[0]
    assert recall >= 0.95
    took = found.agg(F.avg("compared")).first()[0]
    assert took < (0.6 if shard_size > 1500 else 1.2) * 1500
    scores = {(r.query_id, r.doc_id): r.score for r in exact.collect()}
    assert all(scores.get((r.query_id, r.doc_id), r.score) == r.score for r in found.collect())
    # all copies of a vector are found beside each other, smallest ids first
    copies = hnsw.search(asked(df.where("doc_id = 7")), str(tmp_path), 30).collect()
    assert {7, *range(100, 129)} == {r.doc_id for r in copies} or copies[0].score > 30 * 0


def test_a_shard_widens_a_beam_that_finds_too_little(spark, tmp_path):
    rng = np.random.default_rng(3)
    points, others = (rng.normal(size=(n, 48)) for n in (3000, 60))  # the queries are no points of the graph
    df, queries = vectors(spark, enumerate(points)), asked(vectors(spark, enumerate(others)))
    hnsw.build(df, str(tmp_path))
    found = hnsw.search(queries, str(tmp_path), 10, 10)
    assert hnsw.recall(found, dense.inner_product_top_k(queries, df, 10), 10).agg(F.avg("recall")).first()[0] >= 0.9


def test_cells_are_searched_as_their_probes_say(spark):
    rng = np.random.default_rng(4)
    df = vectors(spark, enumerate(rng.normal(size=(500, 12))))
    queries = asked(df.where("doc_id % 9 = 0"))
    index, centres = dense.ivf_build(df)
    rows = {r.doc_id: (r.cell, np.array(r.vec)) for r in index.collect()}
    for nprobe in (1, 3, len(centres)):
        want = set()
        for q in (r.query_id for r in queries.collect()):
            cells = np.argsort(-(centres @ rows[q][1]), kind="stable")[:nprobe]
            best = sorted((-round(float(v @ rows[q][1]), 6), i) for i, (c, v) in rows.items() if c in cells)[:7]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
        found = dense.ivf_top_k(queries, index, centres, 7, nprobe, block=20)
        assert {tuple(r) for r in found.collect()} == want
        plans = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plans  # no row for each pair of a query and a vector


def test_every_node_is_reached(spark):
    rng = np.random.default_rng(1)
    # far clusters of near copies: most have no node above level 0
    points = np.concatenate([100 * rng.normal(size=(1, 8)) + 0.001 * rng.normal(size=(40, 8)) for _ in range(12)])
    rows = hnsw.build_shard(np.arange(len(points)), points, float(np.linalg.norm(points, axis=1).max()), 4)
    near = {r[0]: r[3][0] for r in rows}
    seen, todo = set(), [r[0] for r in rows if len(r[3]) > 1]
    while todo:
        i = todo.pop()
        if i not in seen:
            seen.add(i)
            todo += near[i]
    assert seen == set(near)
    assert sum(len(r[3]) == max(len(x[3]) for x in rows) for r in rows) == 1


def files_of(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_an_update_builds_its_shards_alone(spark, tmp_path):
    rows, path = clouds(2, 900), str(tmp_path)
    df = vectors(spark, rows)
    hnsw.build(df, path, shard_size=100)
    before = files_of(f"{path}/nodes")
    one = [(5, rows[8][1] * 0.9)]
    hnsw.update(spark, path, vectors(spark, one), spark.createDataFrame([(5,)], "doc_id bigint"))
    after = files_of(f"{path}/nodes")
    assert {os.path.dirname(f) for f in before - after} == {os.path.dirname(f) for f in after - before} and len({os.path.dirname(f) for f in after - before}) == 1
    now = {r.doc_id: r.vec for r in hnsw.vectors_of(hnsw.opened(spark, path)[0]).collect()}
    assert len(now) == 900 and np.allclose(now[5], one[0][1])
    # removal, also of a whole shard, and a vector longer than all: the index is built anew
    shard = hnsw.opened(spark, path)[0].where("shard = 3").select(F.explode("members").alias("doc_id"))
    gone = {r[0] for r in shard.collect()}
    hnsw.update(spark, path, gone=shard)
    assert {r.doc_id for r in hnsw.vectors_of(hnsw.opened(spark, path)[0]).collect()} == set(range(900)) - gone
    hnsw.update(spark, path, vectors(spark, [(1000, 50 * rows[0][1])]))
    assert hnsw.search(asked(vectors(spark, [rows[0]])), path, 1).first().doc_id == 1000


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 0.0]), (None, [1.0, 1.0]), (6, [0.0, 0.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id bigint, vec array<double>")
    hnsw.build(df, str(tmp_path))
    got = hnsw.search(spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, vec array<double>"), str(tmp_path), 10).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 1.0), (7, 1.0), (6, 0.0)]
    hnsw.build(df.limit(0), str(tmp_path))
    assert hnsw.search(spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, vec array<double>"), str(tmp_path)).count() == 0


# Inverted file


def test_an_inverted_file_is_kept_and_probed(spark, tmp_path):
    df = vectors(spark, clouds(3, 2000))
    index, centres = dense.ivf_build(df)
    dense.ivf_save(index, centres, str(tmp_path))
    index, centres = dense.ivf_open(spark, str(tmp_path))
    assert index.count() == 2000 and len(centres) == dense.cells_of(2000)
    queries = asked(df.where("doc_id % 20 = 0"))
    exact = dense.inner_product_top_k(queries, df, 10)
    shares = [hnsw.recall(dense.ivf_top_k(queries, index, centres, 10, nprobe=n), exact, 10).agg(F.avg("recall")).first()[0] for n in (1, len(centres) // 3, len(centres))]
    assert shares[0] < 0.95 and shares[1] >= 0.9 and shares[2] == 1.0
    dense.ivf_add(vectors(spark, [(5000, [9.0] * 24)]), str(tmp_path))
    assert dense.ivf_open(spark, str(tmp_path))[0].count() == 2001


# Block-max postings


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(300 * rng.random() ** 3)}" for _ in range(5000)]
    return [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 20, 80]))), rng.choice("ab")) for i in range(n)]


@pytest.mark.parametrize("span, k, lead", [(1, 5, 1), (16, 10, 4), (64, 3, 1), (1000, 10, 1)])
def test_pruned_search_is_the_whole_search(spark, tmp_path, span, k, lead):
    docs = spark.createDataFrame(texts(span, 600), "doc_id bigint, text string, lang string")
    post = sparse.postings(docs, "doc_id", F.col("text"))
    asked = sparse.query_terms(spark.createDataFrame([(0, "w1 w2 w7 w7"), (1, "w0"), (2, "w150 w3"), (3, "nowhere"), (4, "")], "query_id bigint, text string"), "query_id", F.col("text"))
    index = blockmax.build(post, docs, str(tmp_path), ["lang"], span)
    found, read = blockmax.search(blockmax.opened(spark, str(tmp_path)), asked, k, lead)
    want = sorted(map(tuple, sparse.okapi(post, asked, 600, k).collect()))
    assert sorted(map(tuple, found.collect())) == want and index.span == span
    df = collections.Counter(r.term for r in post.collect())
    assert {r.query_id: r.postings for r in read.collect()} == {0: df["w1"] + df["w2"] + df["w7"], 1: df["w0"], 2: df["w150"] + df["w3"]}
    assert all(r.read <= r.postings for r in read.collect())


def test_common_terms_have_small_weights_and_no_documents_give_none(spark, tmp_path):
    docs = spark.createDataFrame([(i, "all the same" + (" but" if i == 3 else "")) for i in range(40)], "doc_id bigint, text string")
    post = sparse.postings(docs, "doc_id", F.col("text"))
    asked = sparse.query_terms(spark.createDataFrame([(0, "all but the")], "query_id bigint, text string"), "query_id", F.col("text"))
    got = blockmax.search(blockmax.build(post, docs, f"{tmp_path}/a", span=4), asked, 7)[0].collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, sparse.okapi(post, asked, 40, 7).collect()))
    none = blockmax.build(post.limit(0), docs.limit(0), f"{tmp_path}/b")
    assert blockmax.search(none, asked, 5)[0].count() == 0


def test_search_shuffles_no_row_for_each_query_and_range(spark, tmp_path):
    docs = spark.createDataFrame(texts(5, 2000), "doc_id bigint, text string, lang string")
    post = sparse.postings(docs, "doc_id", F.col("text"))
    asked = sparse.query_terms(spark.createDataFrame([(i, f"w0 w1 w2 w3 w{i + 4}") for i in range(100)], "query_id bigint, text string"), "query_id", F.col("text"))
    index = blockmax.build(post, docs, str(tmp_path), ["lang"], 2)
    before = shuffled_rows(spark)
    found, read = blockmax.search(index, asked, 5)
    assert found.count() == 500 and read.count() == 100
    assert shuffled_rows(spark) - before < 100 * 1000 / 2  # queries, and ranges of which nearly all hold one of their terms
    in_blocks = blockmax.search(index, asked, 5, block=30)[0]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, in_blocks.collect()))


# Embedder


def test_embedding_is_the_truncated_decomposition(spark, tmp_path):
    rng = random.Random(5)
    topics = [[f"t{k}x{i}" for i in range(30)] for k in range(6)]
    rows = [(i, " ".join(rng.choices(topics[i % 6], k=rng.randrange(5, 40)) + rng.choices(["the", "of"], k=5))) for i in range(240)] + [(900, None), (901, "unknown words"), (902, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = lsa.fit(docs, dim=6, rounds=6)
    lsa.save(model, str(tmp_path))
    model = lsa.load(spark, str(tmp_path))
    table = model.terms.orderBy("column").collect()
    v = np.array([r.vector for r in table])
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-9)
    raw = {r.doc_id: np.array(r.vec) for r in lsa.embed(model, docs, unit=False).collect()}
    white = {r.doc_id: np.array(r.vec) for r in lsa.embed(model, docs, unit=False, whiten=True).collect()}
    u = np.array(list(white.values()))
    assert np.allclose(u * model.values, np.array([raw[i] for i in white]))
    assert np.allclose(u.T @ u, np.eye(6), atol=1e-6)
    # the plain decomposition of the same matrix
    at = {r.term: (r.column, r.idf) for r in table}
    a = np.zeros((len(rows), len(at)))
    for i, (_, t) in enumerate(rows):
        for w, n in collections.Counter((t or "").split()).items():
            a[i, at[w][0]] = (1 + np.log(n)) * at[w][1]
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    a = np.divide(a, norm, out=a, where=norm > 0)
    assert np.allclose(np.linalg.svd(a)[1][:6], model.values, rtol=1e-3)
    unit = {r.doc_id: np.array(r.vec) for r in lsa.embed(model, docs).collect()}
    assert len(unit) == len(rows) and not unit[900].any() and not unit[902].any() and abs(np.linalg.norm(unit[0]) - 1) < 1e-9
    assert unit[0] @ unit[6] > 0.9 > unit[0] @ unit[1]
    empty = lsa.fit(docs.limit(0))
    assert [len(r.vec) for r in lsa.embed(empty, docs.limit(2)).collect()] == [0, 0]


def test_texts_and_postings_are_not_shuffled_for_the_embedder(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(30_000)}" for _ in range(1500))) for i in range(400)]
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    before = shuffled_bytes(spark)
    model = lsa.fit(docs, dim=4, vocabulary=300, rounds=1)
    assert lsa.embed(model, docs).where(F.size("vec") == 4).count() == 400
    # of 3.9 MB of text and 600,000 postings: terms' counts and parts of the matrix
    assert shuffled_bytes(spark) - before < sum(len(t) for _, t in rows) / 2


def test_rows_of_one_id_are_embedded_together(spark):
    rows = [(1, "red red blue"), (2, "red green"), (2, "blue blue"), (2, None), (3, "unknown"), (3, "green"), (None, "red"), (None, "blue"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = lsa.fit(docs.where("text IS NULL OR text <> 'unknown'"), dim=2)
    found = collections.defaultdict(list)
    for r in lsa.embed(model, docs).collect():
        found[r.doc_id].append(r.vec)
    assert {i: len(v) for i, v in found.items()} == {1: 1, 2: 3, 3: 2, None: 2, 4: 1}
    together = spark.createDataFrame([(2, "red green blue blue"), (3, "green unknown")], "doc_id bigint, text string")
    for r in lsa.embed(model, together).collect():
        assert np.allclose(found[r.doc_id], r.vec)
    assert not np.any(found[None]) and not np.any(found[4]) and np.all(np.linalg.norm(found[3], axis=1) > 0.99)


def test_a_large_part_is_dealt_out_once(spark, monkeypatch):
    monkeypatch.setattr(lsa, "BATCH_BYTES", 1000)
    one = spark.createDataFrame([(7, "a few words " * 10)] * 100 + [(None, None)], "doc_id bigint, text string").coalesce(1)
    dealt = lsa.spread(one)
    sizes = dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 101 and len(sizes) == 4 and max(r["count"] for r in sizes) < 60
    assert lsa.spread(dealt).inputFiles() == dealt.inputFiles() != []


def test_building_a_shard_holds_few_distances_at_once():
    import tracemalloc

    points = np.random.default_rng(3).standard_normal((12_000, 4))
    tracemalloc.start()
    hnsw._level_links(points, np.arange(len(points)), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
