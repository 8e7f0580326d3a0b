"""Named queries over the supplied tables, each with the DuckDB statement of the same result.

documents stand for chunks, benchmark for queries, embeddings for vectors, orders, customers, nations
and regions for a dependency graph, events for changes and latency samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwright.functions import text as T
from sparkwright.functions.ordering import new_folder, written
from sparkwright.operators import backends, blockmax, context, dense, fuse, graph, hnsw, lsa, metrics, packing, parse, sparse, summarize
from sparkwright.plans import engine, fixtures
from sparkwright.sources import files as sources
from sparkwright.sources import sinks, store
from sparkwright.streaming import incremental, redgreen
from sparkwright.streaming.paths import pattern

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Retrieval


def _lists(spark: SparkSession, d: str, stem: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Postings of the documents, the queries' terms, and how many documents there are."""
    docs = table(spark, d, "documents")
    asked = sparse.query_terms(table(spark, d, "benchmark"), "item_id", F.col("text"), stem)
    return sparse.postings(docs, "doc_id", F.col("text"), stem), asked, docs.count()


_POSTINGS = f"""
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
tok AS (SELECT doc_id, {TOKENS.format("text")} AS ws FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(ws) AS l, unnest(ws) AS term FROM tok) GROUP BY doc_id, term),
stats AS (SELECT count(*)::DOUBLE AS n, sum(len(ws)) / count(*)::DOUBLE AS avgdl FROM tok),
df AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term)"""
_OKAPI = (
    _POSTINGS
    + """,
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, stats),
mean AS (SELECT avg(raw) AS mean FROM raw),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END AS idf FROM raw, mean),
okapi_scores AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / avgdl))), 6) AS score
 FROM q JOIN idf USING (term) JOIN post USING (term), stats GROUP BY query_id, doc_id HAVING score > 0),
okapi AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM okapi_scores)"""
)


@query(f"WITH {_OKAPI} SELECT * FROM okapi WHERE rank <= 10")
def bm25_okapi_topk(spark, d):
    return sparse.okapi(*_lists(spark, d), 10)


@query(
    f"""WITH t AS (SELECT doc_id, list_distinct({TOKENS.format("text")}) AS ws FROM documents),
v AS (SELECT term FROM (SELECT doc_id, unnest(ws) AS term FROM t) GROUP BY term ORDER BY count(*) DESC, term LIMIT 2000),
known AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(ws) AS term FROM t) JOIN v USING (term))
SELECT doc_id, known.doc_id IS NOT NULL AS embedded, 16 AS dimensions FROM t LEFT JOIN known USING (doc_id)"""
)
def fitted_embedder(spark, d):
    """An embedder fitted to all documents, kept and opened again: documents with a term that it knows have vectors of length 1, others zeros."""
    docs = lsa.spread(table(spark, d, "documents"))
    path = new_folder(spark, "embedder")
    lsa.save(lsa.fit(docs, dim=16, vocabulary=2000), path)
    vec = lsa.embed(lsa.load(spark, path), docs)
    return vec.select("doc_id", (F.abs(dense.dot(F.col("vec"), F.col("vec")) - 1) < 1e-9).alias("embedded"), F.size("vec").alias("dimensions"))


def _blockmax(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    post, asked, _ = _lists(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return blockmax.search(blockmax.build(post, docs, new_folder(spark, "blockmax"), ["lang"], span=2), asked, 10)


@query(ORACLES["bm25_okapi_topk"])
def bm25_blockmax_topk(spark, d):
    """The same ranking from kept postings in blocks, without scoring ranges of documents that can't reach the ten best."""
    return _blockmax(spark, d)[0]


@query(f"WITH {_POSTINGS} SELECT count(DISTINCT query_id) AS queries, sum(df)::BIGINT AS postings, true AS half FROM q JOIN df USING (term)")
def bm25_blockmax_share(spark, d):
    """How many postings the queries' terms have, and whether pruning left half of them or more unread."""
    read = _blockmax(spark, d)[1]
    return read.agg(F.count("*").alias("queries"), F.sum("postings").alias("postings"), (2 * F.sum("read") <= F.sum("postings")).alias("half"))


_FEEDBACK = (
    _OKAPI
    + """,
fb AS (SELECT query_id, doc_id, score / sum(score) OVER (PARTITION BY query_id) AS share FROM okapi WHERE rank <= 10),
weights AS (SELECT query_id, term, round(sum(share * tf / l) * ln((any_value(n) + 1) / (any_value(df) + 1)), 9) AS weight FROM fb JOIN post USING (doc_id) JOIN df USING (term), stats GROUP BY query_id, term),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS r FROM weights)"""
)


@query(f"WITH {_FEEDBACK} SELECT query_id, term, round(weight, 7) AS weight FROM best WHERE r <= 10")
def query_feedback(spark, d):
    """The terms that mark each query's ten first results."""
    post, asked, n = _lists(spark, d)
    return sparse.feedback_terms(post, sparse.okapi(post, asked, n, 10), n).withColumn("weight", F.round("weight", 7))


@query(
    f"""WITH {_FEEDBACK},
more AS (SELECT query_id, term, weight FROM best WHERE r <= 10 AND weight > 0),
size AS (SELECT query_id, sum(qtf) AS size FROM q GROUP BY query_id),
heavy AS (SELECT query_id, sum(weight) AS heavy FROM more GROUP BY query_id),
x AS (SELECT query_id, term, sum(v) AS v FROM (SELECT query_id, term, CASE WHEN heavy IS NULL THEN 1 ELSE 0.5::DOUBLE END * qtf AS v FROM q LEFT JOIN heavy USING (query_id)
 UNION ALL SELECT query_id, term, 0.5::DOUBLE * size * weight / heavy FROM more JOIN size USING (query_id) JOIN heavy USING (query_id)) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(v * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / avgdl))), 6) AS score
 FROM x JOIN idf USING (term) JOIN post USING (term), stats GROUP BY query_id, doc_id HAVING score > 0),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)
SELECT * FROM k WHERE rank <= 10"""
)
def expanded_topk(spark, d):
    """The ranking of the queries with those terms added."""
    post, asked, n = _lists(spark, d)
    more = sparse.expanded(asked, written(sparse.feedback_terms(post, sparse.okapi(post, asked, n, 10), n), "feedback"))
    return sparse.okapi(post, more, n, 10)


@query(
    f"""WITH {_POSTINGS},
idf AS (SELECT term, CASE WHEN n - df <= df THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, stats),
need AS (SELECT query_id, count(*) AS need FROM q GROUP BY query_id),
s AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / avgdl))), 6) AS score, count(*) AS have
 FROM q JOIN idf USING (term) JOIN post USING (term), stats GROUP BY query_id, doc_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s JOIN need USING (query_id) WHERE have = need)
SELECT * FROM r WHERE rank <= 20"""
)
def keyword_all_terms_topk(spark, d):
    return sparse.all_terms(*_lists(spark, d), 20)


@query()
def keyword_stemmed_topk(spark, d):
    return sparse.all_terms(*_lists(spark, d, stem=True), 20)


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS score FROM v a, v b WHERE a.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""
)
def dense_topk(spark, d):
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return dense.inner_product_top_k(own.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), own, 10)


def _overlap(post: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The share of a query's distinct terms that a document holds."""
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("m"))
    score = sparse.meet(asked, post).groupBy("query_id", "doc_id").agg(F.count("*").alias("c")).join(F.broadcast(sizes), "query_id")
    return sparse.top_k(score.select("query_id", "doc_id", F.round(F.col("c") / F.col("m"), 6).alias("score")), k).select("query_id", "rank", "doc_id", "score")


_LISTS = (
    _OKAPI
    + """,
size AS (SELECT query_id, count(*) AS m FROM q GROUP BY query_id),
share AS (SELECT query_id, doc_id, round(count(*) / any_value(m)::DOUBLE, 6) AS score FROM q JOIN post USING (term) JOIN size USING (query_id) GROUP BY query_id, doc_id),
shares AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM share)"""
)
_FUSED = """,
f AS (SELECT query_id, doc_id, round(sum(part), 9) AS score FROM both_lists GROUP BY query_id, doc_id),
g AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM f)
SELECT * FROM g WHERE rank <= 20"""


@query(f"WITH {_LISTS}, both_lists AS (SELECT query_id, doc_id, 1::DOUBLE / (60 + rank) AS part FROM okapi WHERE rank <= 40 UNION ALL SELECT query_id, doc_id, 1::DOUBLE / (60 + rank) FROM shares WHERE rank <= 40){_FUSED}")
def rrf_unweighted(spark, d):
    post, asked, n = _lists(spark, d)
    return fuse.rrf(sparse.okapi(post, asked, n, 40), _overlap(post, asked, 40), 20)


@query(f"WITH {_LISTS}, both_lists AS (SELECT query_id, doc_id, 0.3::DOUBLE / (60 + rank) AS part FROM shares WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, 0.7::DOUBLE / (60 + rank) FROM okapi WHERE rank <= 50){_FUSED}")
def rrf_weighted(spark, d):
    post, asked, n = _lists(spark, d)
    return fuse.weighted_rrf(_overlap(post, asked, 50), sparse.okapi(post, asked, n, 50), 20, alpha=0.3)


@query(
    f"""WITH {_LISTS}, c AS (SELECT query_id, doc_id, o.score AS original_score, coalesce(s.score, 0) AS score FROM okapi o LEFT JOIN share s USING (query_id, doc_id) WHERE rank <= 50),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score, original_score FROM c)
SELECT * FROM r WHERE rank <= 10"""
)
def context_query(spark, d):
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    first = written(sparse.okapi(*_lists(spark, d), 50), "candidates").join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    return context.rerank(first.join(asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id"), 10)


# Text


@query(f"SELECT doc_id, len(ws)::BIGINT AS n_tokens, len(list_distinct(ws))::BIGINT AS n_terms FROM (SELECT doc_id, {TOKENS.format('text')} AS ws FROM documents)")
def tokenize_stats(spark, d):
    own = table(spark, d, "documents").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("ws"))
    return own.select("doc_id", F.size("ws").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("ws")).cast("bigint").alias("n_terms"))


@query(
    """WITH l AS (SELECT doc_id, list_transform(CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS ls FROM documents)
SELECT doc_id, len(list_filter(ls, lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '//')))::BIGINT AS loc,
 round(len(list_filter(ls, lambda x: starts_with(x, '#') OR starts_with(x, '//'))) / len(ls)::DOUBLE, 6) AS comment_ratio FROM l"""
)
def loc_comment_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", T.loc(F.col("text")).cast("bigint").alias("loc"), F.round(T.comment_ratio(F.col("text")), 6).alias("comment_ratio"))


@query(fixtures.REFERENCES_SQL)
def extract_references(spark, d):
    code = spark.createDataFrame(fixtures.CODE, "name string, code string")
    return code.select("name", F.explode(T.references(F.col("code"))).alias("reference"))


@query(fixtures.COMPLETENESS_SQL)
def completeness(spark, d):
    chunks = spark.createDataFrame(fixtures.CHUNK_ROWS, "query_id bigint, chunk_id string, content string, symbol_name string")
    deps = spark.createDataFrame(fixtures.DEPENDENCIES, "query_id bigint, node_id string")
    out = context.completeness(chunks, deps)
    return out.select("query_id", "symbol_resolution", "dependency_coverage", "overall", F.array_join("unresolved", ",").alias("unresolved"), F.array_join("missing", ",").alias("missing"), "is_complete")


# Graph


def _edges(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    name = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    one = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), F.lit(1.0).alias("weight"))
    return (
        one(o, name("o", "o_orderkey"), name("c", "o_custkey"), "order").unionByName(one(c, name("c", "c_custkey"), name("n", "c_nationkey"), "customer"))
        .unionByName(one(n, name("n", "n_nationkey"), name("r", "n_regionkey"), "nation"))
    )


_EDGES = """e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'order' AS type FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'customer' FROM customer
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation' FROM nation)"""


@query(
    f"""WITH RECURSIVE {_EDGES}, w AS (SELECT src AS seed, src AS node_id, 0 AS depth FROM e WHERE type = 'order' UNION ALL SELECT seed, dst, depth + 1 FROM w JOIN e ON w.node_id = e.src WHERE depth < 2)
SELECT DISTINCT seed, node_id FROM w WHERE depth > 0"""
)
def reach_depth_k(spark, d):
    e = _edges(spark, d)
    return graph.reach(e, e.where("type = 'order'").select(F.col("src").alias("seed")), 2)


@query(
    f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node_id, 0 AS depth FROM region UNION ALL SELECT seed, src, depth + 1 FROM w JOIN e ON w.node_id = e.dst WHERE depth < 3)
SELECT DISTINCT seed, node_id FROM w WHERE depth > 0"""
)
def dependents_k(spark, d):
    seeds = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("seed"))
    return graph.reach(_edges(spark, d), seeds, 3, reverse=True)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()


@query(
    f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'r' || r_regionkey AS node_id, 0 AS depth FROM region WHERE r_name < 'B' UNION ALL SELECT src, depth + 1 FROM w JOIN e ON w.node_id = e.dst WHERE depth < 3)
SELECT DISTINCT node_id FROM w"""
)
def dirty_propagation(spark, d):
    changed = table(spark, d, "region").where("r_name < 'B'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"))
    return graph.mark_dirty(_nodes(spark, d), _edges(spark, d), changed)


@query(
    f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node_id, 0 AS hops, 'r' || r_regionkey AS path FROM region
 UNION ALL SELECT root, src, hops + 1, path || '>' || src FROM w JOIN e ON w.node_id = e.dst)
SELECT root, node_id, hops, path FROM w"""
)
def shortest_paths(spark, d):
    """From each region down to its nations, customers and orders, with the path."""
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return graph.shortest_paths(_edges(spark, d), roots, reverse=True).withColumn("path", F.array_join("path", ">"))


@query(
    f"""WITH RECURSIVE {_EDGES}, red AS (SELECT DISTINCT 'c' || user_id AS node_id FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) WHERE was <> event_type),
w AS (SELECT node_id, 0 AS depth FROM red WHERE node_id IN (SELECT src FROM e) UNION ALL SELECT src, depth + 1 FROM w JOIN e ON w.node_id = e.dst WHERE depth < 3)
SELECT DISTINCT node_id FROM w"""
)
def dirty_stream(spark, d):
    """All events as a stream of changes, each event's type its user's content: the nodes whose flag stands at the end, by states alone."""
    folder = new_folder(spark, "dirty")
    nodes = _nodes(spark, d)
    reached = written(redgreen.affected(nodes, _edges(spark, d), origins=nodes.where("node_id like 'c%'")), "affected")  # events change customers alone
    own = spark.readStream.schema(table(spark, d, "events").schema).parquet(pattern(f"{d}/events.parquet"))
    changes = own.select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("node_id"), F.col("event_type").alias("content"), F.col("event_id").alias("seq"), F.lit(False).alias("clean"))
    redgreen.follow(changes, reached, f"{folder}/turns", f"{folder}/checkpoint", redgreen.buckets_for(reached))
    return redgreen.dirty(spark, f"{folder}/turns").select("node_id")


@query(
    f"""WITH RECURSIVE {_EDGES}, w AS (SELECT src AS seed, src AS node_id FROM e WHERE type = 'customer' UNION SELECT seed, dst FROM w JOIN e ON w.node_id = e.src)
SELECT seed, node_id FROM w"""
)
def closure_bfs(spark, d):
    e = _edges(spark, d)
    return graph.closure(e, e.where("type = 'customer'").select(F.col("src").alias("seed")))


@query("SELECT a.c_custkey AS src, b.c_custkey AS dst FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey // 2 + 1 WHERE a.c_mktsegment = 'BUILDING' AND b.c_mktsegment = 'BUILDING'")
def module_subgraph(spark, d):
    c = table(spark, d, "customer")
    own = c.select(F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("file"))
    pairs = c.select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 2 + 1").alias("dst"))
    return graph.subgraph(own, pairs, "file", "BUILDING")[1]


@query(
    f"""WITH {_EDGES}, n AS (SELECT 'n' || n_nationkey AS node_id, n_name FROM nation)
SELECT node_id, n_name, coalesce((SELECT string_agg(DISTINCT src, ',' ORDER BY src) FROM e WHERE dst = node_id), '') AS parents, coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM e WHERE src = node_id), '') AS children FROM n"""
)
def node_context(spark, d):
    own = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), "n_name")
    return graph.context(own, _edges(spark, d)).select("node_id", "n_name", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


def _rank_sql(rounds: int) -> str:
    out = """WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY ALL),
n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), size AS (SELECT count(*)::DOUBLE AS n FROM n), tot AS (SELECT src, sum(w) AS t FROM e GROUP BY src), r0 AS (SELECT id, 1 / n AS r FROM n, size)"""
    for i in range(rounds):
        out += f""",
d{i} AS (SELECT coalesce(sum(r), 0) AS d FROM r{i} WHERE id NOT IN (SELECT src FROM tot)),
s{i} AS (SELECT dst, sum(r * w / t) AS s FROM e JOIN tot USING (src) JOIN r{i} ON id = src GROUP BY dst),
r{i + 1} AS (SELECT id, 0.85::DOUBLE * (coalesce(s, 0) + d / n) + 0.15::DOUBLE / n AS r FROM n LEFT JOIN s{i} ON id = dst, size, d{i})"""
    return out + f" SELECT id AS node_id, round(r, 9) AS centrality FROM r{rounds}"


@query(_rank_sql(10))
def pagerank_fixed_rounds(spark, d):
    e = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("double").alias("weight"))
    e = e.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), "weight")
    nodes = e.select(F.col("src").alias("node_id")).union(e.select("dst"))
    return graph.pagerank(nodes, e, rounds=10, fixed=True)


@query(
    """WITH defs AS (SELECT c_custkey AS id, c_nationkey AS file, 'n' || (c_custkey * 7 // 9) AS name FROM customer),
refs AS (SELECT o_orderkey, (o_custkey % 25)::INT AS file, 'n' || (o_custkey * 7 // 9) AS source, 'n' || (o_orderkey % 1200) AS target FROM orders),
l AS (SELECT file, name, max(id) AS id FROM defs GROUP BY ALL), g AS (SELECT name, min(id) AS id FROM defs GROUP BY name HAVING count(*) = 1)
SELECT o_orderkey, coalesce(a.id, b.id) AS src, coalesce(x.id, y.id) AS dst FROM refs LEFT JOIN l a ON a.file = refs.file AND a.name = source LEFT JOIN g b ON b.name = source
 LEFT JOIN l x ON x.file = refs.file AND x.name = target LEFT JOIN g y ON y.name = target"""
)
def name_resolution(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    defs = c.select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("file"), F.expr("'n' || (c_custkey * 7 div 9)").alias("name"), F.col("c_custkey").alias("ordinal"))
    refs = o.select("o_orderkey", F.expr("cast(o_custkey % 25 as int)").alias("file"), F.expr("'n' || (o_custkey * 7 div 9)").alias("source"), F.expr("'n' || (o_orderkey % 1200)").alias("target"))
    return graph.resolve(refs, defs).select("o_orderkey", "src", "dst")


@query("SELECT user_id AS src, event_id % 50 AS dst, arg_max(event_type, event_id) AS type, arg_max(value, event_id) AS weight FROM events WHERE user_id <> event_id % 50 GROUP BY ALL")
def edge_dedup_last(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 50).alias("dst"), F.col("event_type").alias("type"), F.col("value").alias("weight"), "event_id")
    return graph.last_edges(e, "event_id")


# Digests, resumption, tables


@query("SELECT sha256(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1")
def fingerprint_dups(spark, d):
    own = table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))
    return own.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


_CHANGED = "CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END"


@query(f"SELECT doc_id::VARCHAR AS file_path, sha256({_CHANGED}) AS fingerprint FROM documents WHERE sha256({_CHANGED}) IS DISTINCT FROM sha256(text)")
def fingerprint_skip(spark, d):
    own = table(spark, d, "documents").withColumn("file_path", F.col("doc_id").cast("string"))
    new = own.select("file_path", F.sha2(F.expr(_CHANGED), 256).alias("fingerprint"))
    return store.changed_files(new, own.select("file_path", F.sha2("text", 256).alias("fingerprint")))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def checkpoint_resume(spark, d):
    nodes, done = table(spark, d, "documents").withColumnRenamed("doc_id", "node_id"), table(spark, d, "labels").withColumnRenamed("doc_id", "node_id")
    return summarize.pending(nodes, done).select(F.col("node_id").alias("doc_id"), "source")


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, any_value(n) AS n, round(avg(value), 6) AS mean, max(value) FILTER (i = n // 2) AS p50, max(value) FILTER (i = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95,
 max(value) FILTER (i = least(floor(n * 0.99::DOUBLE), n - 1)) AS p99 FROM r GROUP BY event_type"""
)
def latency_percentiles(spark, d):
    return metrics.latency(table(spark, d, "events"), "event_type", "value")


@query("SELECT count(*) AS entries, sum(octet_length(encode(text)))::BIGINT AS total_bytes FROM documents")
def cache_stats(spark, d):
    return metrics.cache_stats(table(spark, d, "documents").select(F.octet_length("text").alias("file_size_bytes")))


@query("SELECT source, (sum(length(text)) // 4)::BIGINT AS tokens, count(DISTINCT lang) AS files FROM documents GROUP BY source")
def token_estimate(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(context.token_estimate("text").alias("tokens"), F.countDistinct("lang").alias("files"))


@query(
    """SELECT doc_id, text, source FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(source) ELSE text END AS text, source FROM documents WHERE doc_id % 11 <> 0)
UNION ALL SELECT doc_id + 1000000000, 'new ' || lang, source FROM documents WHERE doc_id % 13 = 0"""
)
def incremental_update(spark, d):
    """A table of the store after replacing, adding and removing rows by key."""
    tables = store.Store(spark, new_folder(spark, "store"))
    old = tables.write("docs", table(spark, d, "documents").select("doc_id", "text", "source"))
    new = old.where("doc_id % 5 = 0").withColumn("text", F.upper("source")).unionByName(table(spark, d, "documents").where("doc_id % 13 = 0").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.concat(F.lit("new "), "lang").alias("text"), "source"))
    gone = old.where("doc_id % 11 = 0").select("doc_id")
    tables.upsert("docs", new, ["doc_id"])
    return tables.delete("docs", gone, ["doc_id"])


# Summaries


@query("SELECT conv_id, turn, ((row_number() OVER (ORDER BY conv_id, turn) - 1) // 10)::BIGINT AS batch FROM conversations")
def batch_assign(spark, d):
    return summarize.batches(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], 10)


@query(
    """WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '[u' || turn || '] ' || replace(text, '[', '(') ELSE replace(text, '[', '(') END AS t FROM conversations),
s AS (SELECT *, last_value(nullif(regexp_extract(t, '\\[([^\\]]+)\\]', 1), '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS id, trim(regexp_replace(t, '\\[([^\\]]+)\\]', '', 'g'), ' ') AS b FROM l)
SELECT conv_id, id, string_agg(b, ' ' ORDER BY turn) AS summary FROM s WHERE id IS NOT NULL AND b <> '' GROUP BY conv_id, id"""
)
def response_segment(spark, d):
    c = table(spark, d, "conversations")
    plain = F.replace(F.col("text"), F.lit("["), F.lit("("))
    line = F.when(F.col("role") == "user", F.concat(F.lit("[u"), F.col("turn").cast("string"), F.lit("] "), plain)).otherwise(plain)
    return summarize.segments(c.select("conv_id", "turn", line.alias("t")), "conv_id", "turn", "t")


@query("SELECT conv_id, turn, 'Role ' || role || ' says: ' || text AS prompt, ((12 + length(role) + length(text)) // 4 + length(text) // 4)::BIGINT AS tokens FROM conversations")
def prompt_render(spark, d):
    c = table(spark, d, "conversations")
    prompt = summarize.rendered("Role ${role} says: ${text}", role=F.col("role"), text=F.col("text"))
    return c.select("conv_id", "turn", prompt.alias("prompt"), summarize.tokens_used(prompt, F.col("text")).alias("tokens"))


_SUMMARY = "substr(text, 1, 12 + (doc_id % 90)::INT)"


@query(
    f"""WITH s AS (SELECT doc_id, text, {_SUMMARY} AS s FROM documents), w AS (SELECT *, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) AS n FROM s)
SELECT doc_id, CASE WHEN length(s) < 20 THEN 0.3 WHEN length(s) > length(text) THEN 0.4 WHEN trim(s, ' ' || chr(10)) = trim(text, ' ' || chr(10)) THEN 0.2 WHEN n < 5 THEN 0.4 ELSE least(0.9::DOUBLE, 0.5::DOUBLE + n / 100::DOUBLE) END::DOUBLE AS quality FROM w"""
)
def quality_score(spark, d):
    own = table(spark, d, "documents").withColumn("s", F.expr("substr(text, 1, 12 + cast(doc_id % 90 as int))"))
    return own.select("doc_id", summarize.quality(F.col("s"), F.col("text")).cast("double").alias("quality"))


@query(
    f"""WITH s AS (SELECT doc_id, {_SUMMARY} AS s, substr(source, 1, 2) AS name FROM documents)
SELECT doc_id, length(s) >= 50 AS valid, CASE WHEN length(s) < 50 THEN 0 WHEN NOT contains(s, name) THEN 0.5 ELSE 1 END::DOUBLE AS confidence FROM s"""
)
def validate_summary(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.expr("substr(text, 1, 12 + cast(doc_id % 90 as int))").alias("s"), F.expr("substr(source, 1, 2)").alias("name"))
    return own.withColumn("v", summarize.validity(F.col("s"), F.col("name"))).select("doc_id", "v.valid", F.col("v.confidence").cast("double").alias("confidence"))


@query("SELECT md5(text || ':' || lang || ':') AS cache_key, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY ALL")
def memo_dedupe(spark, d):
    own = table(spark, d, "documents").select("doc_id", T.cache_key(F.col("text"), F.col("lang"), F.lit(None).cast("string")).alias("cache_key"))
    return own.groupBy("cache_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    """WITH b AS (SELECT source, doc_id, '#### ' || lang || ' `d' || doc_id || '`' || chr(10) || chr(10) || '- **Location**: Line ' || doc_id || chr(10) || '- **LOC**: ' || n_chars || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'About ' || source ELSE 'No summary available.' END
 || chr(10) || chr(10) || '---' || chr(10) AS body FROM documents)
SELECT source AS file, '### File: `' || source || '`' || chr(10) || chr(10) || string_agg(body, chr(10) ORDER BY doc_id) AS section FROM b GROUP BY source"""
)
def markdown_rows(spark, d):
    docs = table(spark, d, "documents")
    ids = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    nodes = docs.select(ids.alias("node_id"), F.col("source").alias("file"), F.col("lang").alias("type"), ids.alias("name"), F.col("doc_id").alias("line"), F.lit(None).cast("int").alias("complexity"), F.col("n_chars").alias("loc"))
    return sinks.report_rows(nodes, docs.where("doc_id % 3 = 0").select(ids.alias("node_id"), F.concat(F.lit("About "), "source").alias("summary")))


# Parsing, of inline files


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.FILES, "file string, text string")


@query(fixtures.NODES_SQL)
def parse_nodes(spark, d):
    return parse.nodes(_files(spark)).select("file", "type", "name", "line", "end_line", "complexity", "loc", F.col("error").isNotNull().alias("failed"))


@query(fixtures.EDGES_SQL)
def parse_edges(spark, d):
    return parse.edges(_files(spark)).select("file", "source", "target", "type", "confidence")


@query(fixtures.CHUNKS_SQL)
def chunk_ast(spark, d):
    return parse.chunks(_files(spark).where("file like '%.py'"), min_lines=3).select("chunk_id", "start_line", "end_line", "chunk_type", "symbol_name")


@query(fixtures.PATTERN_SQL)
def chunk_pattern(spark, d):
    return parse.chunks(_files(spark).where("file like '%.py'"), use_ast=False).select("chunk_id", "start_line", "end_line", "chunk_type", "symbol_name")


@query(fixtures.GRAPH_SQL)
def build_graph(spark, d):
    """Files to a resolved graph: (src, dst, type, weight)."""
    files = _files(spark)
    return graph.build(parse.nodes(files).where("error is null"), parse.edges(files))[1].withColumn("weight", F.col("weight").cast("double"))


@query(fixtures.COMPLEXITY_SQL)
def file_complexity(spark, d):
    """Of each parsed file the sum of its nodes' complexity."""
    return parse.complexity_by_file(parse.nodes(_files(spark)))


@query(fixtures.NODE_TEXT_SQL)
def node_texts(spark, d):
    """Sources, docstrings and signatures of parsed nodes."""
    own = parse.nodes(_files(spark)).where("file = 'util.py'")
    return own.select("name", "source_code", "docstring", "signature")


@query(fixtures.CHUNK_PARTS_SQL)
def chunk_parts(spark, d):
    """What chunks call, inherit and import, their docstrings and digests."""
    own = parse.chunks(_files(spark).where("file like '%.py'"), min_lines=1)
    return own.select("chunk_id", *(F.array_join(c, ",").alias(c) for c in ("imports", "calls", "inherits")), "docstring", "complexity", (F.col("fingerprint") == F.sha2("content", 256)).alias("digested"))


@query(fixtures.ROWS_SQL)
def index_rows(spark, d):
    """Chunks as rows of an index, with their metadata."""
    own = parse.index_rows(parse.chunks(_files(spark).where("file like '%.py'"), min_lines=3))
    return own.select("chunk_id", F.length("content").alias("chars"), F.concat_ws("|", "metadata.file_path", "metadata.chunk_type", "metadata.symbol_name", F.col("metadata.start_line").cast("string"), F.col("metadata.end_line").cast("string")).alias("metadata"))


# Retrieval over inline chunks, and the engine


def _engine(spark: SparkSession) -> engine.Engine:
    own = engine.Engine(spark, new_folder(spark, "engine"), embedder=dense.hashed_embedder(64), min_chunk_lines=1)
    own.index(_files(spark))
    return own


@query(fixtures.ENGINE_SQL)
def engine_update(spark, d):
    """Chunks after a file changed, one was deleted and one was indexed again as it is."""
    own = _engine(spark)
    own.index(spark.createDataFrame([("util.py", fixtures.UTIL.replace("helper", "helped")), ("app.py", fixtures.APP)], "file string, text string"))
    own.delete(spark.createDataFrame([("app.py",)], "file_path string"))
    return own.store.read("chunks").select("chunk_id", "symbol_name")


@query(fixtures.STATS_SQL)
def engine_stats(spark, d):
    return _engine(spark).stats().select("files", "bytes", "chunks", "vectors", "nodes", "dirty", "edges")


@query(fixtures.STREAM_SQL)
def change_events(spark, d):
    """Changes applied as a micro-batch: of each file the last one counts."""
    own = engine.Engine(spark, new_folder(spark, "engine"), embedder=dense.hashed_embedder(64), min_chunk_lines=1)
    rows = [("app.py", "create", fixtures.APP, 1), ("util.py", "create", fixtures.APP, 2), ("util.py", "modify", fixtures.UTIL, 3), ("app.py", "delete", None, 4)]
    incremental.apply_changes(own, spark.createDataFrame(rows, incremental.CHANGES))
    incremental.apply_changes(own, spark.createDataFrame(rows, incremental.CHANGES))
    return own.store.read("chunks").select("chunk_id", "symbol_name")


_INLINE = "documents AS (SELECT chunk_id AS doc_id, content AS text FROM chunk), benchmark AS (SELECT query_id AS item_id, text FROM asked)"


@query(f"WITH {fixtures.CONTENT_SQL}, {_INLINE}, {_OKAPI} SELECT * FROM okapi WHERE rank <= 5")
def engine_keyword_search(spark, d):
    asked = spark.createDataFrame(fixtures.ASKED, "query_id bigint, text string")
    return _engine(spark).search(asked, 5, mode="keyword")


@query(f"WITH {fixtures.SEMANTIC_SQL} SELECT query_id, chunk_id AS doc_id FROM asked, chunk WHERE text = content")
def engine_semantic_search(spark, d):
    """A query with a chunk's own words finds that chunk first."""
    asked = spark.createDataFrame(fixtures.CONTENTS_ASKED, "query_id bigint, text string")
    found = _engine(spark).search(asked, 3, mode="semantic")
    return found.where("rank = 1").select("query_id", "doc_id")


@query(fixtures.ANSWER_SQL)
def engine_answer(spark, d):
    """The context request: completeness of the answer to each query."""
    asked = spark.createDataFrame(fixtures.ANSWER_ASKED, "query_id bigint, text string")
    found = _engine(spark).answer(asked, dependency_depth=2)
    return found["completeness"].select("query_id", "symbol_resolution", "dependency_coverage", F.array_join("unresolved", ",").alias("unresolved"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those that are searched for."""
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return own, own.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")


@query(ORACLES["dense_topk"])
def ivf_topk(spark, d):
    """The inverted file, saved and opened again, with every cell probed: vectors meet their queries by cell, and all are found."""
    own, asked = _vectors(spark, d)
    path = new_folder(spark, "ivf")
    dense.ivf_save(*dense.ivf_build(own), path)
    index, centres = dense.ivf_open(spark, path)
    return dense.ivf_top_k(asked, index, centres, 10, nprobe=len(centres))


_REACHED = "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0"


def _reached(found: DataFrame, asked: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """How many queries, and whether the mean recall at 10 against exact search reaches that."""
    return hnsw.recall(found, dense.inner_product_top_k(asked, own, 10), 10).agg(F.count("*").alias("queries"), (F.coalesce(F.avg("recall"), F.lit(1.0)) >= least).alias("reached"))


@query(_REACHED)
def ivf_recall(spark, d):
    """Five sixths of the cells of a kept inverted file find nine tenths of the ten best: the vectors hardly cluster."""
    own, asked = _vectors(spark, d)
    path = new_folder(spark, "ivf")
    dense.ivf_save(*dense.ivf_build(own), path)
    index, centres = dense.ivf_open(spark, path)
    return _reached(dense.ivf_top_k(asked, index, centres, 10, nprobe=-(-5 * len(centres) // 6)), asked, own, 0.9)


@query()
def hnsw_topk(spark, d):
    """The proximity graph, saved and opened again: what each query finds, and how many distances that took."""
    own, asked = _vectors(spark, d)
    path = new_folder(spark, "hnsw")
    hnsw.build(own, path)
    return hnsw.search(asked, path, 10, 32)


@query(_REACHED)
def hnsw_recall(spark, d):
    """The same graph after half of the vectors were added to a kept index finds nine tenths of the ten best."""
    own, asked = _vectors(spark, d)
    path = new_folder(spark, "hnsw")
    odd = F.xxhash64("doc_id") % 2 == 0
    hnsw.build(own.where(odd), path)
    hnsw.update(spark, path, own.where(~odd))
    return _reached(hnsw.search(asked, path, 10, 32), asked, own, 0.9)


# Results


@query("SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS shown, printf('%.2f', n_chars / 7.0::DOUBLE) AS shown_score FROM documents")
def result_snippets(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.col("text").alias("summary"), (F.col("n_chars") / 7).alias("score"))
    return context.snippets(own).select("doc_id", "shown", "shown_score")


@query(
    """WITH r AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, doc_id, text FROM documents), s AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS chars FROM r)
SELECT query_id, rank, doc_id, (chars // 4)::BIGINT AS tokens_so_far FROM s WHERE chars // 4 <= 4096"""
)
def results_within_budget(spark, d):
    own = table(spark, d, "documents").select(F.col("source").alias("query_id"), "doc_id", F.col("text").alias("content"))
    fits = context.within_budget(own, 4096, "doc_id").select("query_id", "doc_id", "tokens_so_far")
    by = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")).cast("bigint")  # of what fits, not of the source
    return fits.withColumn("rank", by)


@query(
    """WITH u AS (SELECT DISTINCT source AS query_id, lang AS name FROM documents), n AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN lang END AS symbol_name FROM documents)
SELECT DISTINCT query_id, 'd' || doc_id AS chunk_id FROM u JOIN n ON n.symbol_name = u.name UNION SELECT DISTINCT source, 'missing-' || source FROM documents"""
)
def completeness_suggestions(spark, d):
    docs = table(spark, d, "documents")
    scored = docs.groupBy(F.col("source").alias("query_id")).agg(F.array_sort(F.collect_set("lang")).alias("unresolved")).withColumn("missing", F.array(F.concat(F.lit("missing-"), "query_id")))
    nodes = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_id"), F.when(F.col("doc_id") % 50 == 0, F.col("lang")).alias("symbol_name"))
    return context.suggestions(scored, nodes)


@query("SELECT doc_id, CASE WHEN contains(text, lang || ' ') THEN substr(text, 1, instr(text, lang || ' ') - 1) || substr(text, instr(text, lang || ' ') + length(lang) + 1) ELSE text END AS content FROM documents")
def strip_first_name(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_name(F.col("text"), F.col("lang")).alias("content"))


@query(
    """SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), ' ', '('), '\\b([a-zA-Z_]\\w*)\\s*\\(', 1)),
 lambda x: x NOT IN ('if','for','while','with','def','class','return','print','str','int','list','dict','set','len','range')))::INT AS n_calls FROM documents"""
)
def document_references(spark, d):
    """References in every document: without other characters than ASCII, and a space made a parenthesis, words are calls."""
    code = F.replace(F.regexp_replace("text", r"[^\x00-\x7F]", ""), F.lit(" "), F.lit("("))
    return table(spark, d, "documents").select("doc_id", F.size(T.references(code)).alias("n_calls"))


@query(
    """WITH n AS (SELECT doc_id, unnest(list_filter(list_distinct(regexp_extract_all(replace(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '', 'g'), ' ', '('), '\\b([a-zA-Z_]\\w*)\\s*\\(', 1)),
 lambda x: x NOT IN ('if','for','while','with','def','class','return','print','str','int','list','dict','set','len','range'))) AS name FROM documents)
SELECT doc_id AS id, name FROM n WHERE name NOT IN (SELECT name FROM n WHERE doc_id % 2 = 0)"""
)
def unknown_names(spark, d):
    """Names in documents, their words made calls, that no document of an even id has: those are the nodes here."""
    code = F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", ""), F.lit(" "), F.lit("("))
    own = table(spark, d, "documents").select(F.col("doc_id").alias("id"), code.alias("text"))
    nodes = own.where("id % 2 = 0").select(F.explode(T.references(F.col("text"))).alias("name"))
    return context.unknown_names(own, nodes)


@query(
    """WITH refs AS (SELECT DISTINCT source AS query_id, 'f' || (doc_id % 40) AS name FROM documents), defs AS (SELECT DISTINCT source AS query_id, 'f' || (doc_id % 30) AS name FROM documents WHERE doc_id % 3 > 0),
j AS (SELECT query_id, refs.name, defs.name AS known FROM refs LEFT JOIN defs USING (query_id, name))
SELECT query_id, count(known) / count(*)::DOUBLE AS symbol_resolution, round(0.7::DOUBLE * (count(known) / count(*)::DOUBLE) + 0.3::DOUBLE, 6) AS overall, coalesce(string_agg(name, ',' ORDER BY name) FILTER (known IS NULL), '') AS unresolved FROM j GROUP BY query_id"""
)
def document_completeness(spark, d):
    """Every document as a chunk that calls one name and may define another."""
    docs = table(spark, d, "documents")
    name = lambda n: F.concat(F.lit("f"), (F.col("doc_id") % n).cast("string"))
    chunks = docs.select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.concat(name(40), F.lit("(x)")).alias("content"), F.when(F.col("doc_id") % 3 > 0, name(30)).otherwise("").alias("symbol_name"))
    return context.completeness(chunks).select("query_id", "symbol_resolution", "overall", F.array_join("unresolved", ",").alias("unresolved"))


@query(
    f"""WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT o_orderpriority AS query_id, 'o' || o_orderkey AS doc_id FROM orders WHERE o_orderkey % 50 = 0),
w AS (SELECT query_id, doc_id AS node_id, 0 AS depth FROM s UNION SELECT query_id, dst, depth + 1 FROM w JOIN e ON w.node_id = e.src WHERE depth < 2)
SELECT DISTINCT query_id, node_id FROM w WHERE depth > 0"""
)
def expand_results(spark, d):
    """What the results of each query depend on within two steps."""
    own = table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderpriority").alias("query_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("doc_id"))
    return context.expand(own, _edges(spark, d), 2)


@query(
    f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'o' || o_orderkey AS seed, 'o' || o_orderkey AS node_id, 0 AS depth FROM orders WHERE o_orderkey % 20 = 0 UNION ALL SELECT seed, dst, depth + 1 FROM w JOIN e ON w.node_id = e.src WHERE depth < 3 AND e.type IN ('order', 'nation'))
SELECT DISTINCT seed, node_id FROM w WHERE depth > 0"""
)
def typed_reach(spark, d):
    """Only edges of some types are walked, so what lies beyond others is not reached."""
    seeds = table(spark, d, "orders").where("o_orderkey % 20 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("seed"))
    return graph.reach(_edges(spark, d), seeds, 3, types=["order", "nation"])


def _node_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return c.select(key.alias("node_id"), F.col("c_mktsegment").alias("node_type"), F.col("c_nationkey").cast("string").alias("file_path"), F.col("c_name").alias("symbol_name"), F.sha2("c_name", 256).alias("fingerprint"), (F.col("c_custkey") % 3 == 0).alias("is_dirty"), F.lit(None).cast("map<string,string>").alias("metadata"))


@query("SELECT 'c' || c_custkey AS node_id, CASE WHEN c_custkey % 5 = 0 THEN sha256(c_name || '!') ELSE sha256(c_name) END AS fingerprint, c_custkey % 5 <> 0 AND c_custkey % 3 = 0 AS is_dirty FROM customer UNION ALL SELECT 'new', sha256('x'), false")
def add_graph_nodes(spark, d):
    own = _node_rows(spark, d)
    new = own.where("cast(substr(node_id, 2) as int) % 5 = 0").withColumn("content", F.concat("symbol_name", F.lit("!"))).select("node_id", "node_type", "file_path", "symbol_name", "content", "metadata")
    one = spark.createDataFrame([("new", "f", "p", "s", "x", None)], new.schema)
    return graph.add_nodes(own, new.unionByName(one)).select("node_id", "fingerprint", "is_dirty")


@query("SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1")
def dirty_list(spark, d):
    """The dirty nodes, after the even ones were marked clean."""
    own = _node_rows(spark, d)
    return graph.dirty_nodes(graph.set_dirty(own, own.where("cast(substr(node_id, 2) as int) % 2 = 0"), False)).select("node_id")


@query(
    f"""WITH {_EDGES} SELECT 'c' || c_custkey AS node_id, c_name AS symbol_name, CASE WHEN c_custkey % 2 = 0 THEN 'source of ' || c_name ELSE '' END AS source, coalesce((SELECT count(DISTINCT src) FROM e WHERE dst = 'c' || c_custkey), 0)::INT AS n_parents, 'n' || c_nationkey AS children
FROM customer WHERE c_custkey % 10 = 0"""
)
def node_details(spark, d):
    own = _node_rows(spark, d)
    sources = own.where("cast(substr(node_id, 2) as int) % 2 = 0").select("node_id", F.concat(F.lit("source of "), "symbol_name").alias("source"))
    wanted = own.where("cast(substr(node_id, 2) as int) % 10 = 0").select("node_id").union(spark.createDataFrame([("unknown",)], "node_id string"))
    return graph.details(own, _edges(spark, d), sources, wanted).select("node_id", "symbol_name", "source", F.size("parents").alias("n_parents"), F.array_join("children", ",").alias("children"))


@query(
    """WITH n AS (SELECT p_partkey AS node_id, p_retailprice AS centrality, p_size AS complexity FROM part), l AS (SELECT quantile_disc(centrality, 0.9) AS c, quantile_disc(complexity, 0.9) AS x FROM n)
SELECT node_id, centrality >= c AND complexity >= x AS is_critical FROM n, l"""
)
def critical_nodes(spark, d):
    own = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_retailprice").alias("centrality"), F.col("p_size").alias("complexity"))
    return graph.critical(own).select("node_id", "is_critical")


@query("SELECT coalesce(r.doc_id, l.doc_id) AS doc_id, coalesce(r.source, l.source) AS source FROM documents l FULL JOIN (SELECT doc_id + 1 AS doc_id, 'right' AS source FROM documents WHERE doc_id % 4 = 0) r ON l.doc_id = r.doc_id")
def merge_right_wins(spark, d):
    """Two mappings by key; the right one's values win."""
    old = table(spark, d, "documents").select("doc_id", "source")
    new = old.where("doc_id % 4 = 0").select((F.col("doc_id") + 1).alias("doc_id"), F.lit("right").alias("source"))
    return store.merged(old, new, "doc_id")


# Cache tables


@query("SELECT sha256(text) AS fingerprint, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS files FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_files(spark, d):
    own = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), T.fingerprint(F.col("text")).alias("fingerprint"))
    return store.copies(own).withColumn("files", F.array_join("files", ","))


@query("SELECT doc_id::VARCHAR AS file_path, lang AS symbol FROM documents UNION ALL SELECT doc_id::VARCHAR, source FROM documents")
def cached_symbols(spark, d):
    own = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.to_json(F.array("lang", "source")).alias("symbols"))
    return store.all_symbols(own)


@query("SELECT doc_id::VARCHAR AS file_path, sha256(text) AS fingerprint FROM documents WHERE doc_id::VARCHAR = '17'")
def cache_lookup(spark, d):
    own = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), T.fingerprint(F.col("text")).alias("fingerprint"))
    return store.by_path(own, "17")


@query("SELECT 'docs' AS name, count(*) AS n FROM documents UNION ALL SELECT 'cleared', 0")
def store_clear(spark, d):
    """A table that was cleared is gone; another one isn't."""
    tables = store.Store(spark, new_folder(spark, "store"))
    docs = table(spark, d, "documents").select("doc_id")
    tables.write("docs", docs)
    tables.write("cleared", docs)
    tables.clear("cleared")
    count = lambda name: tables.read(name).count() if tables.exists(name) else 0
    return spark.createDataFrame([(name, count(name)) for name in ("docs", "cleared")], "name string, n bigint")


@query(
    """WITH p AS (SELECT doc_id, source || '/' || CASE doc_id % 4 WHEN 0 THEN 'venv/' WHEN 1 THEN 'lib/venv/' ELSE '' END || 'f' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.TSX' WHEN 2 THEN '.js' ELSE '.md' END AS file FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'typescript' END AS language, doc_id % 4 = 0 AND doc_id % 7 <> 0 OR doc_id % 4 = 1 AND doc_id % 7 <> 0 AS ignored, doc_id % 5 = 0 AND doc_id % 4 > 1 AS listed FROM p"""
)
def path_rules(spark, d):
    """Languages, ignore rules (a later one takes back an earlier one's matches) and lists by suffix, over a path for each document."""
    docs = table(spark, d, "documents")
    part = F.when(F.col("doc_id") % 4 == 0, "venv/").when(F.col("doc_id") % 4 == 1, "lib/venv/").otherwise("")
    end = F.when(F.col("doc_id") % 5 == 0, ".py").when(F.col("doc_id") % 5 == 1, ".TSX").when(F.col("doc_id") % 5 == 2, ".js").otherwise(".md")
    own = docs.select("doc_id", F.concat("source", F.lit("/"), part, F.lit("f"), F.col("doc_id").cast("string"), end).alias("file"))
    keep = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("file"), F.lit(".keep"))).otherwise(F.col("file"))
    listed = sources.by_extension(own, (".py",), ("**/venv/**",)).select("doc_id", F.lit(True).alias("listed"))
    ruled = own.select("doc_id", sources.language_of(F.col("file")).alias("language"), sources.ignored(keep, ["# comment", "**/venv/*", "!*.keep"]).alias("ignored"))
    return ruled.join(listed, "doc_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


# Generation


@query(
    """SELECT doc_id AS item_id, replace(template, 'e', 'E') AS summary, ((length(template) // 4) + (length(template) // 4))::BIGINT AS tokens_used, false AS cached FROM (SELECT doc_id, 'Write a docstring for this function.' || chr(10) || chr(10) || 'Code:' || chr(10) || coalesce(text, '') || chr(10) AS template FROM documents)"""
)
def memoised_summaries(spark, d):
    """Each content once, through a generator that answers with the prompt, changed, then to every item that has it."""
    items = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("content"), F.lit("abstractive").alias("summary_type"), F.lit("function_doc").alias("prompt_id"))
    return summarize.memoised(items, fixtures.shout)[0].select("item_id", "summary", "tokens_used", "cached")


@query("SELECT doc_id AS item_id, doc_id % 2 = 0 AS cached FROM documents")
def memoised_again(spark, d):
    """What an earlier run generated is found in its cache."""
    docs = table(spark, d, "documents")
    items = docs.select(F.col("doc_id").alias("item_id"), F.col("doc_id").cast("string").alias("content"), F.lit("abstractive").alias("summary_type"), F.lit(None).cast("string").alias("prompt_id"))
    cache = summarize.memoised(items.where("item_id % 2 = 0"), fixtures.shout)[1]
    return summarize.memoised(items, fixtures.shout, cache=cache)[0].select("item_id", "cached")


@query("SELECT count(*) AS items, sum(2 * (length(t) // 4))::BIGINT AS tokens, 0::DOUBLE AS latency_ms FROM (SELECT 'Write a docstring for this function.' || chr(10) || chr(10) || 'Code:' || chr(10) || doc_id || chr(10) AS t FROM documents)")
def batch_totals(spark, d):
    docs = table(spark, d, "documents")
    items = docs.select(F.col("doc_id").alias("item_id"), F.col("doc_id").cast("string").alias("content"), F.lit("abstractive").alias("summary_type"), F.lit("function_doc").alias("prompt_id"))
    return summarize.batch_totals(summarize.memoised(items, fixtures.shout)[0])


def _summary_nodes(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    key = F.concat(F.lit("n"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    return table(spark, d, "customer").select(key.alias("node_id"), F.lit("function").alias("type"), F.col("c_name").alias("name"), F.lit("f.py").alias("file"), F.col("c_name").alias("source_code"), F.lit(None).cast("string").alias("docstring"), none.alias("parents"), none.alias("children"))


@query("SELECT 'n' || lpad(c_custkey::VARCHAR, 6, '0') AS node_id, ((row_number() OVER (ORDER BY c_custkey) - 1) // 10)::BIGINT AS batch, 'The function ' || c_name || ' is defined by the line: ' || c_name || ' and is summarised by its text.' AS summary, true AS valid, 1::DOUBLE AS confidence FROM customer")
def summarize_batches(spark, d):
    """Prompts, calls, answers and their checks, by batches of ten."""
    return summarize.summarize(_summary_nodes(spark, d)).select("node_id", "batch", "summary", "valid", "confidence")


@query("WITH b AS (SELECT DISTINCT ((row_number() OVER (ORDER BY c_custkey) - 1) // 10)::BIGINT AS batch FROM customer) SELECT phase, count(*) AS n FROM (SELECT unnest(['batch_start', 'llm_call_start', 'llm_call_success', 'batch_done']) AS phase FROM b UNION ALL SELECT 'node_validated' FROM customer) GROUP BY phase")
def summary_events(spark, d):
    """A run by waves of fifty batches into a table, as a log of events by phase."""
    return summarize.run(_summary_nodes(spark, d), store.Store(spark, new_folder(spark, "store")), cadence=50).groupBy("phase").agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT DISTINCT ((row_number() OVER (ORDER BY c_custkey) - 1) // 10)::BIGINT AS batch FROM customer) SELECT CASE WHEN batch < 2 THEN 'llm_call_error' ELSE 'disabled' END AS phase, count(*) AS n FROM b GROUP BY 1")
def disabled_run(spark, d):
    """A connection error in the first wave of two batches disables the others."""
    events = summarize.run(_summary_nodes(spark, d), store.Store(spark, new_folder(spark, "store")), fixtures.unreachable, cadence=2)
    return events.where("phase in ('llm_call_error', 'disabled')").groupBy("phase").agg(F.count("*").alias("n"))


@query("SELECT l.doc_id AS node_id, 'quality ' || quality AS summary, coalesce(d.lang, '') AS type, coalesce(d.source, '') AS name FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) d USING (doc_id)")
def summary_attributes(spark, d):
    nodes = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("node_id"), F.col("lang").alias("type"), F.col("source").alias("name"), F.lit("f").alias("file"))
    own = table(spark, d, "labels").select(F.col("doc_id").alias("node_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("summary"))
    return summarize.with_attributes(own, nodes).select("node_id", "summary", "type", "name")


@query(fixtures.PROMPTS_SQL)
def prompt_registry(spark, d):
    """The prompts of a type after one was added and one deleted."""
    own = summarize.PromptRegistry()
    own.register(summarize.Prompt("mine", "Mine", "${x}", "abstractive", variables=["x"]))
    own.delete("function_doc")
    return own.frame(spark).where("summary_type = 'abstractive'").select("id", "name", F.array_join("variables", ",").alias("variables"))


@query("SELECT role AS kind, CASE role WHEN 'user' THEN 'code_extractive' ELSE 'code_abstractive' END AS prompt FROM (SELECT DISTINCT role FROM conversations)")
def default_prompts(spark, d):
    kinds = table(spark, d, "conversations").select(F.col("role").alias("kind")).distinct()
    return kinds.select("kind", summarize.default_prompt(F.when(F.col("kind") == "user", "extractive").otherwise(F.col("kind"))).alias("prompt"))


@query("SELECT 'healthy' AS status, 1 AS n_healthy UNION ALL SELECT 'unhealthy', 0")
def backend_health(spark, d):
    """Of named backends any healthy one is enough."""
    broken = backends.create_backend("chat", model="m", transport=fixtures.unreachable)
    each = [backends.Backends("echo", {"echo": backends.create_backend("echo"), "chat": broken}).health(), backends.Backends("chat", {"chat": broken}).health()]
    return spark.createDataFrame([(h["status"], h["n_healthy"]) for h in each], "status string, n_healthy int")


@query("SELECT count(DISTINCT node)::BIGINT AS nodes, (SELECT count(*) FROM orders)::BIGINT AS edges FROM (SELECT 'o' || o_orderkey AS node FROM orders UNION SELECT 'c' || o_custkey FROM orders)")
def report_counts(spark, d):
    """What the report's overview counts."""
    e = _edges(spark, d).where("type = 'order'")
    return sinks.overview(e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct(), e)
