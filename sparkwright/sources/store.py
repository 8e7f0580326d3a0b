"""Named tables in a folder, each a chain of complete versions of Parquet files.

A write makes a new version and then a marker file; readers take the newest marked one. So readers never
see half a table, a failed write leaves the last version, and a table may be read while it is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Paths go through Hadoop's file systems, so the folder may be anywhere that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.folder}/{name}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".done"))

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str) -> DataFrame | None:
        """None if the table was never written."""
        found = self.versions(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/v{found[-1]}") if found else None

    def write(self, name: str, df: DataFrame, keep: int = 2) -> DataFrame:
        """Replaces the table; `keep` versions stay, for readers that are under way."""
        found = self.versions(name)
        version = (found[-1] if found else 0) + 1
        path = f"{self.folder}/{name}/v{version}"
        df.write.mode("overwrite").parquet(path)
        fs, p = self._fs(f"{path}.done")
        fs.create(p, True).close()
        for old in found[: max(0, len(found) + 1 - keep)]:
            for x in (f"{self.folder}/{name}/v{old}.done", f"{self.folder}/{name}/v{old}"):
                fs, p = self._fs(x)
                fs.delete(p, True)
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame, key: list[str]) -> DataFrame:
        """Rows whose key is there replace the old ones. Of rows with one key, one stays."""
        rows = rows.dropDuplicates(key)
        old = self.read(name)
        merged = rows if old is None else old.join(rows.select(*key), key, "left_anti").select(*rows.columns).unionByName(rows)
        return self.write(name, merged)

    def delete(self, name: str, keys: DataFrame, key: list[str]) -> DataFrame | None:
        old = self.read(name)
        return None if old is None else self.write(name, old.join(keys.select(*key).distinct(), key, "left_anti").select(*old.columns))

    def clear(self, name: str | None = None) -> None:
        fs, p = self._fs(f"{self.folder}/{name}" if name else self.folder)
        fs.delete(p, True)

    def stats(self) -> DataFrame:
        """(name, files, megabytes) of the newest versions; no row for an empty store."""
        fs, p = self._fs(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
        out = self.spark.createDataFrame([], "name string, files bigint, megabytes double")
        for name in sorted(names):
            if self.exists(name):
                own = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.folder}/{name}/v{self.versions(name)[-1]}")
                out = out.unionByName(own.agg(F.lit(name).alias("name"), F.count("*").alias("files"), (F.coalesce(F.sum("length"), F.lit(0)) / 1048576).alias("megabytes")))
        return out


def by_path(cache: DataFrame, file: str) -> DataFrame:
    return cache.where(F.col("file_path") == file)


def copies(cache: DataFrame) -> DataFrame:
    """(fingerprint, n, files): contents that stand in several files, all paths sorted."""
    return cache.groupBy("fingerprint").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("file_path")).alias("files")).where("n > 1")


def all_symbols(cache: DataFrame) -> DataFrame:
    """cache(file_path, symbols as JSON text) -> (file_path, symbol)."""
    return cache.select("file_path", F.explode(F.from_json("symbols", "array<string>")).alias("symbol"))


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Two tables of one schema as mappings by key: the new one's rows win."""
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def changed_files(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new(file_path, fingerprint, ...) whose fingerprint is not the stored one."""
    old = stored.select("file_path", F.col("fingerprint").alias("_old"))
    return new.join(old, "file_path", "left").where(~F.col("fingerprint").eqNullSafe(F.col("_old"))).drop("_old")
