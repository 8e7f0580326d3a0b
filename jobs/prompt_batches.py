"""Prepares a summarisation run over a document table: one prompt for each distinct content, in batches by token budget.

    python -m jobs.prompt_batches --documents DIR --out DIR [--config jobs/prompt_batches.json]

Equal contents share a prompt (that of the smallest doc_id, null last); the others wait for its answer under the same cache key.
Prompts of one folder are packed into batches that no model call exceeds. Output, a row for each document, by folder:

    OUT/source=S    doc_id, cache_key, asked, kind, batch, tokens, prompt (the last four null unless asked)

The whole output is written anew, so a run after a failure or over the same table gives the same rows.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions import text as T
from sparkwright.operators import packing, summarize

LOG = logging.getLogger("jobs.prompt_batches")
DEFAULTS = {"budget": 4096, "prompt_id": "function_doc", "summary_type": "abstractive", "folder": "source"}


def prepared(docs: DataFrame, conf: dict) -> DataFrame:
    """documents -> (doc_id, <folder>, cache_key, asked, kind, batch, tokens, prompt)."""
    template = summarize.PromptRegistry().get(conf["prompt_id"]).template
    content = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(conf["folder"]).cast("string").alias("folder"), content.alias("content"),
        T.cache_key(content, F.lit(conf["summary_type"]), F.lit(conf["prompt_id"])).alias("cache_key"),
    )
    # ids, keys and sizes are sorted and joined; texts move once, to their batch
    length = F.length(summarize.rendered(template, code=F.col("content")))
    sizes = keyed.select("doc_id", "folder", "cache_key", F.floor(length / 4).alias("tokens"))
    first = sizes.groupBy("cache_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "folder")).alias("f"), F.min("tokens").alias("tokens"))
    packed = packing.pack(first.select("cache_key", F.col("f.folder").alias("folder"), F.col("f.doc_id").alias("item_id"), "tokens"), conf["budget"])
    packed = packed.select("cache_key", F.col("folder").alias("_folder"), "item_id", "kind", "batch", "tokens")
    both = keyed.join(packed, "cache_key")
    asked = F.col("doc_id").eqNullSafe(F.col("item_id")) & F.col("folder").eqNullSafe(F.col("_folder"))
    only = lambda c: F.when(F.col("asked"), c)
    return both.withColumn("asked", asked).select(
        "doc_id", F.col("folder").alias(conf["folder"]), "cache_key", "asked", only(F.col("kind")).alias("kind"), only(F.col("batch")).alias("batch"),
        only(F.col("tokens")).alias("tokens"), only(summarize.rendered(template, code=F.col("content"))).alias("prompt"),
    )


def output(spark: SparkSession, out: str, folder: str = "source") -> DataFrame:
    schema = f"doc_id bigint, cache_key string, asked boolean, kind string, batch bigint, tokens bigint, prompt string, `{folder}` string"
    return spark.read.schema(schema).parquet(out)


def run(spark: SparkSession, documents: str, out: str, config: dict | None = None) -> dict:
    """Writes the batches; returns how many documents were read, prompts are asked and batches there are."""
    conf = DEFAULTS | (config or {})
    docs = spark.read.parquet(documents)
    folder = conf["folder"]
    prepared(docs, conf).hint("rebalance", folder).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(folder).parquet(out)
    made = output(spark, out, folder)
    n = made.agg(F.count("*"), F.count_if("asked"), F.count_distinct(F.when(F.col("asked"), F.struct(folder, "kind", "batch")))).first()
    found = {"read": docs.count(), "written": n[0], "prompts": n[1], "batches": n[2]}
    LOG.info("read %(read)d documents, wrote %(written)d rows with %(prompts)d prompts in %(batches)d batches", found)
    return found


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="a JSON file")
    asked = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("prompt-batches").getOrCreate()
    try:
        conf = json.loads("".join(r[0] for r in spark.read.text(asked.config, wholetext=True).collect())) if asked.config else {}
        print(json.dumps(run(spark, asked.documents, asked.out, conf)))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
