"""Sparse retrieval: postings and two forms of BM25, each over batches of queries.

Queries meet postings in an equi-join on the term, so only documents that share a term are scored. The
postings are read several times, so they should be a table (see postings()). Where the queries' terms are
few they are sent to the postings, and so a frequent term's rows stay spread as they are; more of them
meet the postings by shuffle, where the engine splits what is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwright.functions import text as T
from sparkwright.functions.ordering import written

#: More rows of query terms than this and they are joined by shuffle.
BROADCAST_TERMS = 500_000
#: Characters of text whose terms a task counts.
TASK_CHARS = 4_000_000


def top_k(scored: DataFrame, k: int, score: str = "score", group: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """rank from 1 by score, the largest first, ties by id; ranks over k go. Spark limits each group before the sort."""
    by = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(by).cast("bigint")).where(F.col("rank") <= k)


def terms(docs: DataFrame, doc_id: str, text: Column, stem: bool = False) -> DataFrame:
    """(doc_id, term, tf, len): the postings, a row for each distinct term of a document.

    Texts are dealt by document, so its terms are counted where they are found, and so are its scores later. A task has TASK_CHARS
    of text or so, however much there is in all: what it counts at once stays small.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), text.alias("text"))
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    own = own.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)), "doc_id")
    words = T.tokens(F.coalesce("text", F.lit("")))
    words = T.stems(words) if stem else words
    own = own.select("doc_id", words.alias("words"))
    each = own.select("doc_id", F.size("words").cast("bigint").alias("len"), F.explode("words").alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def postings(docs: DataFrame, doc_id: str, text: Column, stem: bool = False) -> DataFrame:
    """terms() as a table in the shared folder: texts are split once, however many lists are made from them."""
    return written(terms(docs, doc_id, text, stem), "postings")


def meet(weights: DataFrame, postings: DataFrame) -> DataFrame:
    """weights(query_id, term, ...) joined with postings on the term."""
    weights = written(weights, "query-terms")
    few = weights.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return postings.join(F.broadcast(weights) if few else weights, "term")


def corpus(postings: DataFrame, n_docs: int) -> DataFrame:
    """One row: n documents, of whom some may be empty, and their mean length."""
    sizes = postings.groupBy("doc_id").agg(F.first("len").alias("len"))
    return sizes.agg(F.lit(n_docs).cast("double").alias("n"), (F.coalesce(F.sum("len"), F.lit(0)) / F.greatest(F.lit(1.0), F.lit(float(n_docs)))).alias("avgdl"))


def query_terms(queries: DataFrame, query_id: str, text: Column, stem: bool = False) -> DataFrame:
    """(query_id, term, qtf): how often a query repeats a term."""
    words = T.tokens(F.coalesce(text, F.lit("")))
    words = T.stems(words) if stem else words
    return queries.select(F.col(query_id).alias("query_id"), F.explode(words).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def okapi(postings: DataFrame, queries: DataFrame, n_docs: int, k: int = 50, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """BM25 Okapi: (query_id, rank, doc_id, score), any term may match, repeated query terms count repeatedly.

    A negative idf becomes epsilon times the mean idf of all terms; scores of 0 or less go.
    """
    stats = corpus(postings, n_docs)
    df = postings.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    raw = df.crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.join(queries.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(mean))
    idf = idf.select("term", "avgdl", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    hit = meet(queries.join(idf, "term"), postings)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    score = hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return top_k(score, k).select("query_id", "rank", "doc_id", "score")


def all_terms(postings: DataFrame, queries: DataFrame, n_docs: int, k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The keyword search's BM25: (query_id, rank, doc_id, score) of documents that hold all of a query's terms.

    The idf has a floor of 1e-6; postings should be of stems, and a document's length that of all its columns. Documents that hold a
    query's rarest term are its candidates; those alone meet its other terms.
    """
    need = queries.groupBy("query_id").agg(F.count("*").alias("need"))
    df = postings.join(queries.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = df.crossJoin(F.broadcast(corpus(postings, n_docs)))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = idf.select("term", "df", "avgdl", F.when(raw <= 0, F.lit(1e-6)).otherwise(raw).alias("idf"))
    weights = written(queries.join(idf, "term"), "query-weights")
    # a document that holds all of a query's terms holds its rarest one: only those are looked at further
    rarest = weights.groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count("*").alias("known"))
    rarest = rarest.join(need, "query_id").where("known = need").select("query_id", "term")
    held = written(meet(rarest, postings).select("query_id", "doc_id"), "candidates")
    hit = postings.join(weights.select("term").distinct(), "term", "left_semi").join(held, "doc_id").join(weights, ["query_id", "term"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    score = hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("have")).join(need, "query_id")
    return top_k(score.where("have = need"), k).select("query_id", "rank", "doc_id", "score")


def feedback_terms(postings: DataFrame, first: DataFrame, n_docs: int, terms: int = 10, digits: int = 9) -> DataFrame:
    """first(query_id, doc_id, score): the first results of each query -> (query_id, term, weight): the terms that mark them.

    A term's weight is the sum over a query's results of the result's share of all their scores, times the term's share of the
    document, times ln((n + 1) / (df + 1)). The heaviest terms stay, ties by term.
    """
    total = first.groupBy("query_id").agg(F.sum("score").alias("total"))
    share = first.join(total, "query_id").where("total > 0").select("query_id", "doc_id", (F.col("score") / F.col("total")).alias("share"))
    own = postings.join(share, "doc_id").select("query_id", "term", (F.col("share") * F.col("tf") / F.col("len")).alias("part"))
    near = own.groupBy("query_id", "term").agg(F.sum("part").alias("part"))
    df = postings.join(near.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.round(F.col("part") * F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)), digits)
    weighed = near.join(df, "term").select("query_id", "term", weight.alias("weight"))
    return top_k(weighed, terms, "weight", tie="term").select("query_id", "term", "weight")


def expanded(queries: DataFrame, feedback: DataFrame, share: float = 0.5) -> DataFrame:
    """query_terms() with feedback_terms(): (query_id, term, qtf), where the feedback has this share of a query's weight.

    A query's own terms keep the rest in proportion; one without feedback stays as it is.
    """
    own = queries.join(queries.groupBy("query_id").agg(F.sum("qtf").alias("sum")), "query_id")
    more = feedback.where("weight > 0")
    more = more.join(more.groupBy("query_id").agg(F.sum("weight").alias("weights")), "query_id").join(own.select("query_id", "sum").distinct(), "query_id")
    told = more.select("query_id", F.lit(True).alias("told")).distinct()
    own = own.join(told, "query_id", "left").select("query_id", "term", F.when(F.col("told"), (1 - share) * F.col("qtf")).otherwise(F.col("qtf")).cast("double").alias("qtf"))
    more = more.select("query_id", "term", (share * F.col("sum") * F.col("weight") / F.col("weights")).alias("qtf"))
    return own.unionByName(more).groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))
