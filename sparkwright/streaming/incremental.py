"""A stream of file changes into the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkwright.plans.engine import Engine

CHANGES = "file string, change string, text string, seq bigint"


def apply_changes(engine: Engine, changes: DataFrame) -> None:
    """changes(file, change: create, modify or delete, text, seq): of each file the last one counts. Applying them again changes nothing."""
    last = changes.groupBy("file").agg(F.max_by(F.struct("change", "text"), "seq").alias("c")).select("file", "c.*")
    last = engine.store.write("changes", last, keep=1)
    gone = last.where("change = 'delete'").select(F.col("file").alias("file_path"))
    if engine.store.exists("chunks") and not gone.isEmpty():
        engine.delete(gone)
    new = last.where("change <> 'delete'").select("file", "text")
    if not new.isEmpty():
        engine.index(new)


def follow(engine: Engine, changes: DataFrame, checkpoint: str) -> StreamingQuery:
    """A streaming table of changes; each micro-batch is applied, and a batch that is replayed does no harm."""
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply_changes(engine, batch)).trigger(availableNow=True).start()
