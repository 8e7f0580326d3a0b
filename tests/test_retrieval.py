import math
import sqlite3

import pytest
from measure import shuffled_rows
from pyspark.sql import functions as F

from sparkwright.operators import context, dense, fuse, sparse

ROWS = [
    (1, "b:bar:2", "bar", "b.py", "bar runs the parser run run"), (2, "a:foo:1", "foo", "a.py", "foo parses running files"), (3, "c:baz:3", "baz", "c.py", "baz does other things entirely"),
    (4, "d:q:4", "q", "d.py", "q nothing here at all ok"), (5, "e:r:5", "r", "e.py", "r zip zap"),
]


def keyword(spark, text):
    docs = spark.createDataFrame([(i, " ".join(r)) for i, *r in ROWS], "doc_id bigint, text string")
    asked = sparse.query_terms(spark.createDataFrame([(1, text)], "query_id bigint, text string"), "query_id", F.col("text"), stem=True)
    return [(r.doc_id, r.score) for r in sparse.all_terms(sparse.terms(docs, "doc_id", F.col("text"), stem=True), asked, len(ROWS)).orderBy("rank").collect()]


@pytest.mark.parametrize("text", ["run", "running parse", "zap", "files", "things"])
def test_keyword_search_scores_as_fts5(spark, text):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(node_id, name, file, content, tokenize='porter')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    con.executemany("INSERT INTO t(rowid, node_id, name, file, content) VALUES (?, ?, ?, ?, ?)", ROWS)
    want = con.execute("SELECT rowid, -rank FROM t WHERE t MATCH ? ORDER BY rank, rowid", (text,)).fetchall()
    got = keyword(spark, text)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-6)


def test_punctuation_is_no_syntax(spark):
    assert keyword(spark, "how does the parser work?") == []


def test_only_documents_with_the_rarest_term_meet_a_querys_terms(spark):
    docs = spark.createDataFrame([(i, "all of these are common" + (f" rare{i % 7}" if i % 100 == 0 else "")) for i in range(3000)], "doc_id bigint, text string")
    asked = [(q, f"all of these are common rare{q}") for q in range(7)] + [(q, "all of these nowhere") for q in range(7, 40)]
    asked = sparse.query_terms(spark.createDataFrame(asked, "query_id bigint, text string"), "query_id", F.col("text"))
    post = sparse.postings(docs, "doc_id", F.col("text"))
    before = shuffled_rows(spark)
    got = sparse.all_terms(post, asked, 3000, 20).collect()
    assert shuffled_rows(spark) - before < 3000 * 40 / 4  # the documents that share a term with each query
    assert {r.query_id: set() for r in got}.keys() == set(range(7))
    assert {(r.query_id, r.doc_id) for r in got} == {(i % 7, i) for i in range(0, 3000, 100)}


def test_fusion_by_hand(spark):
    ranked = lambda ids: spark.createDataFrame([(1, r, i) for r, i in enumerate(ids, 1)], "query_id bigint, rank bigint, doc_id bigint")
    out = fuse.weighted_rrf(ranked([1, 2, 3]), ranked([2, 4, 1]), 10).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in out] == [(2, 0.016261), (1, 0.016133), (4, 0.008065), (3, 0.007937)]
    out = fuse.rrf(ranked([1]), ranked([2]), 2).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in out] == [(1, round(1 / 61, 9)), (2, round(1 / 61, 9))]


def test_dense_blocks_agree(spark):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, vec array<double>")
    asked = docs.withColumnRenamed("doc_id", "query_id")
    one, many = (sorted(map(tuple, dense.inner_product_top_k(asked, docs, 3, block=b).collect())) for b in (100, 4))
    assert one == many and len(one) == 60


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    asked = sparse.query_terms(spark.createDataFrame([(1, "a")], "query_id bigint, text string"), "query_id", F.col("text"))
    assert sparse.okapi(sparse.terms(none, "doc_id", F.col("text")), asked, 0).count() == 0


def test_feedback_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "green tree here")], "doc_id bigint, text string")
    post = sparse.postings(docs, "doc_id", F.col("text"))
    first = spark.createDataFrame([(0, 1, 3.0), (0, 2, 1.0), (5, 3, 0.0)], "query_id bigint, doc_id bigint, score double")
    got = {(r.query_id, r.term): r.weight for r in sparse.feedback_terms(post, first, 3, 2).collect()}
    assert got == {(0, "red"): pytest.approx(0.75 * 2 / 3 * math.log(4 / 2)), (0, "fox"): pytest.approx((0.75 / 3 + 0.25 / 2) * math.log(4 / 3))}
    asked = spark.createDataFrame([(0, "fox", 2), (9, "tree", 1)], "query_id bigint, term string, qtf bigint")
    feedback = spark.createDataFrame([(0, "red", 3.0), (0, "fox", 1.0)], "query_id bigint, term string, weight double")
    assert {(r.query_id, r.term): r.qtf for r in sparse.expanded(asked, feedback).collect()} == {(0, "fox"): 1.25, (0, "red"): 0.75, (9, "tree"): 1.0}


def test_budget_is_the_running_sum(spark):
    rows = [(q, i, "x" * (7 * i % 40)) for q in ("a", None) for i in range(60)] + [("b", 0, "y" * 900), ("c", 0, None)]
    got = sorted(((r.query_id or "", r["rank"], r.tokens_so_far) for r in context.within_budget(spark.createDataFrame(rows, "query_id string, rank bigint, content string").repartition(5), 100).collect()))
    want, so_far = [], {}
    for q, i, text in rows:
        so_far[q] = so_far.get(q, 0) + len(text or "")
        if so_far[q] // 4 <= 100:
            want.append((q or "", i, so_far[q] // 4))
    assert got == sorted(want)


def test_names_that_no_node_has(spark):
    texts = spark.createDataFrame([(1, "calls load() and made_up(x)"), (2, None), (3, "save()"), (4, "made_up() made_up()")], "id bigint, text string")
    nodes = spark.createDataFrame([("load",), ("save",), (None,)], "name string")
    assert sorted(map(tuple, context.unknown_names(texts, nodes).collect())) == [(1, "made_up"), (4, "made_up")]


def test_more_text_is_counted_by_more_tasks(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 10_000).alias("text"))
    found = sparse.terms(docs, "doc_id", F.col("text"))
    assert found.rdd.getNumPartitions() == 9  # of 33,000,000 characters
    assert found.count() == 600 and {(r.tf, r.len) for r in found.select("tf", "len").distinct().collect()} == {(10_000, 20_000)}
