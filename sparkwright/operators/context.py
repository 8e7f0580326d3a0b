"""Answers to batches of queries: reranking, dependency expansion, completeness, token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions import text as T
from sparkwright.functions.ordering import running_sums
from sparkwright.operators.graph import reach
from sparkwright.operators.sparse import top_k


def overlap(query: Column, content: Column) -> Column:
    """The stand-in reranker's score: the share of a query's distinct tokens that the content holds."""
    asked = F.array_distinct(T.tokens(query))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, T.tokens(content))) / F.size(asked))


def rerank(candidates: DataFrame, k: int = 10, scorer=overlap) -> DataFrame:
    """candidates(query_id, query, doc_id, content, score) -> (query_id, rank, doc_id, score, original_score), the scorer's k best, ties by id."""
    scored = candidates.select("query_id", "doc_id", F.round(scorer(F.col("query"), F.col("content")), 6).alias("score"), F.col("score").alias("original_score"))
    return top_k(scored, k or 10).select("query_id", "rank", "doc_id", "score", "original_score")


def expand(results: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(query_id, doc_id) -> (query_id, node_id): what the results depend on, without what they are."""
    found = reach(edges, results.select(F.col("doc_id").alias("seed")).distinct(), depth)
    wide = results.join(found, results.doc_id == found.seed).select("query_id", "node_id").distinct()
    return wide.join(results.select("query_id", F.col("doc_id").alias("node_id")), ["query_id", "node_id"], "left_anti")


def completeness(chunks: DataFrame, dependencies: DataFrame | None = None, threshold: float = 0.9) -> DataFrame:
    """chunks(query_id, chunk_id, content, symbol_name), dependencies(query_id, node_id) -> one row for each query:
    symbol_resolution, dependency_coverage, overall = 0.7 and 0.3 of them, unresolved, missing, is_complete.

    Symbols are resolved if some chunk of the query defines them; a share of nothing is 1.
    """
    refs = chunks.select("query_id", F.explode(T.references(F.coalesce("content", F.lit("")))).alias("name")).distinct()
    defs = chunks.where("symbol_name <> ''").select("query_id", F.col("symbol_name").alias("name"), F.lit(1).alias("known")).distinct()
    symbols = refs.join(defs, ["query_id", "name"], "left").groupBy("query_id").agg(F.count("*").alias("n_refs"), F.count("known").alias("n_known"), F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("name")))).alias("unresolved"))
    out = chunks.select("query_id").distinct().join(symbols, "query_id", "left")
    none = F.array().cast("array<string>")
    if dependencies is not None:
        have = chunks.select("query_id", F.col("chunk_id").alias("node_id"), F.lit(1).alias("here")).distinct()
        deps = dependencies.distinct().join(have, ["query_id", "node_id"], "left")
        deps = deps.groupBy("query_id").agg(F.count("*").alias("n_deps"), F.count("here").alias("n_have"), F.array_sort(F.collect_list(F.when(F.col("here").isNull(), F.col("node_id")))).cast("array<string>").alias("missing"))
        out = out.join(deps, "query_id", "left")
    else:
        out = out.withColumns({"n_deps": F.lit(0), "n_have": F.lit(0), "missing": none})
    share = lambda a, b: F.when(F.coalesce(F.col(b), F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col(a) / F.col(b))
    out = out.select("query_id", share("n_known", "n_refs").alias("symbol_resolution"), share("n_have", "n_deps").alias("dependency_coverage"), F.coalesce("unresolved", none).alias("unresolved"), F.coalesce("missing", none).alias("missing"))
    out = out.withColumn("overall", F.round(0.7 * F.col("symbol_resolution") + 0.3 * F.col("dependency_coverage"), 6))
    return out.withColumn("is_complete", F.col("overall") >= threshold)


def suggestions(scored: DataFrame, nodes: DataFrame, symbols: int = 10, dependencies: int = 5) -> DataFrame:
    """(query_id, chunk_id): nodes of the first unresolved symbols, and the first missing dependencies, distinct."""
    named = scored.select("query_id", F.explode(F.slice("unresolved", 1, symbols)).alias("symbol_name"))
    found = named.join(nodes.select("symbol_name", F.col("node_id").alias("chunk_id")), "symbol_name").select("query_id", "chunk_id")
    return found.unionByName(scored.select("query_id", F.explode(F.slice("missing", 1, dependencies)).alias("chunk_id"))).distinct()


def token_estimate(column: str) -> Column:
    """Of a group: characters of all contents by four, whole."""
    return F.expr(f"coalesce(sum(length(`{column}`)), 0) div 4")


def within_budget(ranked: DataFrame, max_tokens: int, order: str = "rank", content: str = "content") -> DataFrame:
    """ranked(query_id, rank, content): the best rows whose running token estimate fits, with tokens_so_far.

    Only ids and lengths are sorted, by range, so a query of very many rows is no one task; the rows that fit are then looked up.
    A query's values of `order` differ.
    """
    own = ranked.select("query_id", order, F.coalesce(F.length(content), F.lit(0)).cast("bigint").alias("_n"))
    placed = running_sums(own, ["query_id"], [order], "_n", "_before")
    fits = placed.select(F.col("query_id").alias("_q"), F.col(order).alias("_o"), F.floor((F.col("_before") + F.col("_n")) / 4).alias("tokens_so_far")).where(F.col("tokens_so_far") <= max_tokens)
    return ranked.join(fits, F.col("query_id").eqNullSafe(F.col("_q")) & F.col(order).eqNullSafe(F.col("_o"))).drop("_q", "_o")


def unknown_names(texts: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """texts(id, text), nodes(name) -> (id, name): names that a text, such as a summary, refers to and no node has: what a model made up.

    References are those of T.references(); texts are read once and their names meet the nodes' in one anti join.
    """
    named = texts.select("id", F.explode(T.references(F.coalesce(text, F.lit("")))).alias("name"))
    return named.join(nodes.select("name").distinct(), "name", "left_anti").select("id", "name")


def snippets(results: DataFrame, width: int = 150) -> DataFrame:
    """results(summary, score) as shown: the summary cut with dots, the score with two digits."""
    cut = F.when(F.length("summary") > width, F.concat(F.substring("summary", 1, width), F.lit("..."))).otherwise(F.col("summary"))
    return results.withColumns({"shown": cut, "shown_score": F.format_string("%.2f", F.col("score"))})
