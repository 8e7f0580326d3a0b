"""Keeps a keyword index of a growing document table: postings for BM25 search, and a catalogue of what is indexed.

    python -m jobs.keyword_index --documents DIR --out DIR --checkpoint DIR [--config jobs/keyword_index.json]

A file stream with a checkpoint takes the files that are new since the last run. Of a document's versions the latest counts (by
the file's modification time, then by fingerprint); documents whose text is indexed already as it is are skipped. Output:

    OUT/documents/batch=N    doc_id, fingerprint, len
    OUT/postings/bucket=B/batch=N    doc_id, term, tf, len

A micro-batch overwrites its own partitions only, so one that is replayed after a failure gives the same files' worth of rows.
Postings of a version that a later batch replaced stay in their partitions; current() leaves them out.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwright.functions import text as T
from sparkwright.operators import sparse
from sparkwright.streaming.paths import pattern

LOG = logging.getLogger("jobs.keyword_index")
DEFAULTS = {"max_files": 64, "bucket_digits": 1}
CATALOGUE = "doc_id bigint, fingerprint string, len bigint, batch bigint"
POSTINGS = "doc_id bigint, term string, tf bigint, len bigint, bucket string, batch bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by path; empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def latest(catalogue: DataFrame) -> DataFrame:
    """Of each document the last indexed version: (doc_id, batch, fingerprint)."""
    return catalogue.groupBy("doc_id").agg(F.max(F.struct("batch", "fingerprint", "len")).alias("v")).select("doc_id", "v.*")


def add(rows: DataFrame, number: int, out: str, digits: int) -> None:
    """One micro-batch into the partitions batch=number."""
    spark = rows.sparkSession
    texts = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("_metadata.file_modification_time").alias("at"))
    texts = texts.withColumn("fingerprint", T.fingerprint(F.col("text")))
    order = Window.partitionBy("doc_id").orderBy(F.desc("at"), F.desc("fingerprint"))
    texts = texts.where("doc_id is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    known = latest(_read(spark, f"{out}/documents", CATALOGUE).where(F.col("batch") < number))
    fresh = texts.join(known.select("doc_id", "fingerprint"), ["doc_id", "fingerprint"], "left_anti").select("doc_id", "fingerprint", "text").persist()
    try:
        n = fresh.count()
        LOG.info("batch %d: %d new or changed documents", number, n)
        if not n:
            return
        terms = sparse.terms(fresh, "doc_id", F.col("text"))
        posted = terms.select("*", F.substring(F.md5("term"), 1, digits).alias("bucket"), F.lit(number).cast("bigint").alias("batch"))
        own = lambda w: w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        own(posted.hint("rebalance", "bucket").write.partitionBy("bucket", "batch")).parquet(f"{out}/postings")
        named = fresh.select("doc_id", "fingerprint", F.size(T.tokens(F.col("text"))).cast("bigint").alias("len"), F.lit(number).cast("bigint").alias("batch"))
        own(named.hint("rebalance").write.partitionBy("batch")).parquet(f"{out}/documents")
    finally:
        fresh.unpersist()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The index as it stands: (doc_id, term, tf, len, bucket) of each document's last version."""
    last = latest(_read(spark, f"{out}/documents", CATALOGUE)).select("doc_id", "batch")
    return _read(spark, f"{out}/postings", POSTINGS).join(last, ["doc_id", "batch"]).select("doc_id", "term", "tf", "len", "bucket")


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Indexes what is new under `documents`; returns how many rows were read and how many documents and postings the index has."""
    conf = DEFAULTS | (config or {})
    schema = spark.read.parquet(documents).select("doc_id", "text").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", conf["max_files"]).parquet(pattern(documents)).select("doc_id", "text", "_metadata")
    query = (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda rows, number: add(rows, number, out, conf["bucket_digits"])).start()
    )
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    found = {"read": read, "documents": latest(_read(spark, f"{out}/documents", CATALOGUE)).count(), "postings": current(spark, out).count()}
    LOG.info("read %(read)d rows; the index has %(documents)d documents and %(postings)d postings", found)
    return found


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="a JSON file")
    asked = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("keyword-index").getOrCreate()
    try:
        conf = json.loads("".join(r[0] for r in spark.read.text(asked.config, wholetext=True).collect())) if asked.config else {}
        print(json.dumps(run(spark, asked.documents, asked.out, asked.checkpoint, conf)))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
