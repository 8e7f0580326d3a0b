"""Places in a global order, without a task that holds all rows of an order or of a group."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset on a local master, a temporary folder, which is set from then on."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for what is read more than once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `place`, from 0, in the order of these columns; of equal rows in any order.

    Sorted by range; the partitions' row counts, a number each, give the places at which they start. The
    sorted rows are checkpointed first, as another run might cut the ranges elsewhere.
    """
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ordered = cut(ordered)
    counts = {r[0]: r[1] for r in ordered.groupBy("_p").count().collect()}
    starts, so_far = [], 0
    for p in sorted(counts):
        starts.append((p, so_far))
        so_far += counts[p]
    offsets = spark.createDataFrame(starts, "_p int, _start bigint")
    place = F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33) + F.col("_start")
    return ordered.join(F.broadcast(offsets), "_p").withColumn("place", place).drop("_p", "_m", "_start")


def running_sums(rows: DataFrame, by: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """rows with `name`: the sum of `value` over those of the same group (null is a group too) that come earlier in the order; 0 for the first.

    Sorted by range over group and order, so a large group lies in many partitions. Sums inside a partition are a
    window over that partition's part of the group; what lies before the part is a sum over the parts' totals, a row
    for each group and partition. Rows that are equal in group and order come in any order, but the same on each reading.
    """
    keys = [*by, *order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ordered = cut(ordered)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    totals = ordered.groupBy(*by, "_p").agg(F.sum(value).cast("bigint").alias("_sum"))
    starts = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy(*by).orderBy("_p"))), zero))
    starts = starts.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(by)), F.col("_p").alias("_q"), "_start")
    inside = ordered.withColumn("_in", F.coalesce(F.sum(value).over(earlier(Window.partitionBy(*by, "_p").orderBy("_m"))), zero))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)), F.col("_p") == F.col("_q"))
    return inside.join(starts, same).select(*rows.columns, (F.col("_in") + F.col("_start")).alias(name))
