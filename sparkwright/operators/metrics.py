"""Latency summaries by index, cache statistics and a phase profiler."""

from __future__ import annotations

import json
import resource
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.ordering import numbered


def latency(samples: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, p50, p95, p99): the values at index n // 2 and min(int(n * p), n - 1) of the sorted ones."""
    rows = samples.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"))
    placed = numbered(rows, [group, "v"])
    n = placed.groupBy(group).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("place").alias("first"))
    ranked = placed.join(n, group).withColumn("i", F.col("place") - F.col("first"))
    at = lambda share: F.least(F.floor(F.col("n") * F.lit(share)), F.col("n") - 1)
    pick = lambda index, name: F.max(F.when(F.col("i") == index, F.col("v"))).alias(name)
    return ranked.groupBy(group).agg(F.first("n").alias("n"), F.round(F.first("mean"), 6).alias("mean"), pick(F.expr("n div 2"), "p50"), pick(at(0.95), "p95"), pick(at(0.99), "p99"))


def cache_stats(cache: DataFrame) -> DataFrame:
    """One row: entries and total bytes, 0 for none."""
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"))


class Profiler:
    """Wall time and peak memory of named phases on the driver."""

    def __init__(self) -> None:
        self.phases: dict[str, dict] = {}
        self.began = time.time()

    @contextmanager
    def phase(self, name: str, **extra):
        start, memory = time.time(), self._memory()
        try:
            yield self
        finally:
            now = self._memory()
            self.phases[name] = {"start": start, "duration": time.time() - start, "memory_mb": now, "memory_delta_mb": now - memory} | extra

    @staticmethod
    def _memory() -> float:
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024

    def metrics(self) -> dict:
        return {"phases": self.phases, "peak_memory_mb": max([0.0, *(p["memory_mb"] for p in self.phases.values())]), "total_seconds": time.time() - self.began}

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.metrics(), f, indent=2)
