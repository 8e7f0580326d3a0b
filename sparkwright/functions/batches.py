"""Bounds on what travels to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python in Arrow batches: a bound on their bytes keeps the memory of both sides small.

    One value for all operators, so that none changes another's plan that has not run yet; a session that sets
    the option itself keeps its own.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))
