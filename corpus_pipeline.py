"""The corpus pipeline: five stages, each on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with all columns of
`documents`; the last one returns the token file's rows. run() applies them in turn, writing each
stage's rows to the shared folder and reading them back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkwright.llm import decontaminate, mixing, repair, simhash, toxicity
from sparkwright.llm.common import discard, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model calls toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose fingerprints are linked, one stays: that of the smallest id."""
    return simhash.keep_first(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources meet their target weights."""
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of what is left, read back."""
    return repair.token_file(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)  # the one before last: nothing reads it again
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: Stages 1, 2, 4 and 5 (a fitted model, XXH64 fingerprints, balanced sampling, a tokenizer) have no SQL form.
ORACLE_SQL = None
