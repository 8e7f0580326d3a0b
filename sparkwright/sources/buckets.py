"""A table whose rows are dealt to buckets by the hash of a key: an update rewrites the buckets of its keys and no other.

The folder is partitioned by bucket; writes go by dynamic partition overwrite, so Spark's committer puts the new
files of a bucket in place of the old ones. An update that fails, or is run again, leaves or gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from sparkwright.functions.ordering import written

BUCKETS = 64
BUCKET = "bucket"


class Buckets:
    """Rows of one schema, keyed by `key` columns (null is a value). The number of buckets belongs to the folder: give the same on each opening."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        if BUCKET in self.schema.fieldNames():
            raise ValueError(f"a column must not be called {BUCKET}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        """With the bucket, by which reads are pruned; no rows where nothing was written."""
        full = StructType(list(self.schema.fields)).add(BUCKET, IntegerType())
        try:
            return self.spark.read.schema(full).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], full)
            raise

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys; only their buckets' files are opened."""
        named = keys.select(*self.key).distinct()
        return self._matching(self._stored().where(F.col(BUCKET).isin(self._touched(named))), named, "left_semi").drop(BUCKET)

    def _touched(self, named: DataFrame) -> list[int]:
        """Numbers of buckets, of which there are self.buckets at most."""
        return [r[0] for r in named.select(self._bucket()).distinct().collect()]

    def _matching(self, rows: DataFrame, named: DataFrame, how: str) -> DataFrame:
        other = named.select(*(F.col(c).alias(f"_{c}") for c in self.key))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.key]
        return rows.join(other, same, how)

    def _dynamic(self, rows: DataFrame) -> None:
        rows.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def overwrite(self, rows: DataFrame) -> None:
        """The whole table anew."""
        rows = written(rows.select(*self.schema.fieldNames()), "rows")
        rows.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(self.path)

    def replace(self, keys: DataFrame, rows: DataFrame | None = None) -> list[int]:
        """All rows of `keys`, and of the keys of `rows`, give way to `rows`, of which several may have one key. Returns the buckets that were written."""
        new = written(rows.select(*self.schema.fieldNames()) if rows is not None else self.spark.createDataFrame([], self.schema), "new-rows")
        named = written(keys.select(*self.key).unionByName(new.select(*self.key)).distinct(), "named")
        touched = self._touched(named)
        if not touched:
            return []
        old = self._stored().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        merged = written(self._matching(old, named, "left_anti").unionByName(new), "merged")
        left = {r[0] for r in merged.select(self._bucket()).distinct().collect()}
        self._dynamic(merged)
        for gone in set(touched) - left:  # an overwrite without rows for a bucket would leave its old ones
            merged.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{BUCKET}={gone}")
        return sorted(touched)

    def upsert(self, rows: DataFrame) -> list[int]:
        """One row for each key: of several new ones the largest by all columns."""
        new = written(rows.select(*self.schema.fieldNames()), "upsert")
        best = new.groupBy(*self.key).agg(F.max(F.struct(*self.schema.fieldNames())).alias("_row")).select("_row.*")
        return self.replace(new.select(*self.key), best)

    def delete(self, keys: DataFrame) -> list[int]:
        return self.replace(keys)
