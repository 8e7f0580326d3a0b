"""Reciprocal rank fusion of two ranked lists, batches of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.operators.sparse import top_k


def _fused(a: DataFrame, b: DataFrame, wa: float, wb: float, k: int, rrf_k: int) -> DataFrame:
    part = lambda df, w: df.select("query_id", "doc_id", (F.lit(w) / (F.lit(rrf_k) + F.col("rank"))).alias("part"))
    both = part(a, wa).unionByName(part(b, wb))
    score = both.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top_k(score, k).select("query_id", "rank", "doc_id", "score")


def rrf(keyword: DataFrame, semantic: DataFrame, k: int = 20, rrf_k: int = 60) -> DataFrame:
    """(query_id, rank, doc_id) twice -> (query_id, rank, doc_id, score): the sum of 1 / (rrf_k + rank), ranks from 1, of the best 2k of each."""
    head = lambda df: df.where(F.col("rank") <= 2 * k)
    return _fused(head(keyword), head(semantic), 1.0, 1.0, k, rrf_k)


def weighted_rrf(dense: DataFrame, sparse: DataFrame, k: int = 20, alpha: float = 0.5, rrf_k: int = 60, candidates: int = 50) -> DataFrame:
    """As rrf(), alpha for the dense list and 1 - alpha for the sparse one, of the best `candidates` of each."""
    head = lambda df: df.where(F.col("rank") <= candidates)
    return _fused(head(dense), head(sparse), alpha, 1 - alpha, k, rrf_k)
