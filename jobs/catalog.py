"""The jobs as queries: each runs twice over the whole tables into one new folder, and gives the output as it stands then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import keyword_index, prompt_batches
from sparkwright.functions.ordering import new_folder
from sparkwright.plans.catalog import TOKENS


def job1_keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1")
    for _ in range(2):
        keyword_index.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    return keyword_index.current(spark, f"{folder}/index")


def job2_prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    for _ in range(2):
        prompt_batches.run(spark, f"{sf_dir}/documents.parquet", folder)
    return prompt_batches.output(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_keyword_index": job1_keyword_index, "job2_prompt_batches": job2_prompt_batches}
ORACLES = {
    "job1_keyword_index": f"""WITH w AS (SELECT doc_id, {TOKENS.format("text")} AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS l, unnest(ws) AS term FROM w)
SELECT doc_id, term, count(*) AS tf, any_value(l) AS len, substr(md5(term), 1, 1) AS bucket FROM t GROUP BY doc_id, term""",
    "job2_prompt_batches": """WITH d AS (SELECT doc_id, source, md5(coalesce(text, '') || ':abstractive:function_doc') AS cache_key,
 'Write a docstring for this function.' || chr(10) || chr(10) || 'Code:' || chr(10) || coalesce(text, '') || chr(10) AS prompt FROM documents),
f AS (SELECT *, length(prompt) // 4 AS n, row_number() OVER (PARTITION BY cache_key ORDER BY doc_id NULLS LAST) = 1 AS asked FROM d),
k AS (SELECT *, CASE WHEN n > 4096 THEN 'over' WHEN 2 * n > 4096 THEN 'alone' WHEN 4 * n > 4096 THEN 'pair' ELSE 'small' END AS kind FROM f WHERE asked),
b AS (SELECT doc_id, cache_key, kind, n, coalesce(sum(CASE WHEN kind = 'small' THEN n ELSE 1 END) OVER (PARTITION BY source, kind ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT f.doc_id, f.source, f.cache_key, f.asked, b.kind, (b.before // CASE b.kind WHEN 'small' THEN 3072 WHEN 'pair' THEN 2 ELSE 1 END)::BIGINT AS batch,
 b.n::BIGINT AS tokens, CASE WHEN f.asked THEN f.prompt END AS prompt
FROM f LEFT JOIN b ON f.asked AND f.doc_id = b.doc_id AND f.cache_key = b.cache_key""",
}
