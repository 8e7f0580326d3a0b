"""What the operators share: the shared folder, table access and row identity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions.batches import BATCH_BYTES, bounded_batches  # noqa: F401

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Only where it is unset on a local master (tests, a single machine) a temporary one is made and set; on a
    cluster, whose nodes would each write to their own, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder, by further options of Parquet's, and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(compression=compression, **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes the folder of a table that stored() wrote and that nothing will read again; other tables are left alone."""
    path = getattr(df, "stored_at", None)
    if path:
        context = df.sparkSession.sparkContext
        name = context._jvm.org.apache.hadoop.fs.Path(path)
        name.getFileSystem(context._jsc.hadoopConfiguration()).delete(name, True)


def col(name: str) -> Column:
    """A column by its whole name, which may hold dots and back-quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Three columns k0, k1, k2 that are never null and equal for rows of equal id and text: such rows are decided together."""
    own = F.col(doc_id).cast("bigint")
    return [own.isNull().alias("k0"), F.coalesce(own, F.lit(0)).alias("k1"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("k2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a plain path; None for any other scheme."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
