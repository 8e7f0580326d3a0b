"""Red-green marking as a stateful stream: which nodes a change of content makes dirty, while changes arrive.

The first state, by node, is the digest of its content: a row whose digest is the one known (or the first of its node) is
green and goes no further; a red one is joined with the nodes that depend on its node. The second state, by node, is the dirty flag: a row is
given out when a node turns dirty, and when it is marked clean again. Both live in the state store, so a stream that is
stopped and started again goes on where it was, and no table is rewritten.

Nodes share a key of the state store by buckets of some thousand, each with a small table as its value, so that Python is
called and the store asked once for a bucket and not for each node. Between the states a node's changes are one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from sparkwright.operators import graph

CHANGES = "node_id string, content string, seq bigint, clean boolean"
_RED = "node_id string, reds array<bigint>, cleans array<bigint>"
TURNS = "node_id string, is_dirty boolean, seq bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Nodes that share a bucket, or about so many; and the fewest buckets.
BUCKET, BUCKETS = 4096, 64


class Bucketed(StatefulProcessor):
    """A bucket's table in the state store."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("bucket", StructType([StructField("buckets", LongType()), StructField("rows", BinaryType())]))

    def read(self, columns: list[str]) -> pd.DataFrame:
        held = self.value.get()
        if held is None:
            return pd.DataFrame({c: [] for c in columns}).set_index("node_id")
        if held[0] != self.buckets:
            raise ValueError(f"this checkpoint's states have {held[0]} buckets, not {self.buckets}")
        with pa.ipc.open_stream(pa.py_buffer(bytes(held[1]))) as stream:
            return stream.read_all().to_pandas().set_index("node_id")

    def keep(self, before: pd.DataFrame, new: pd.DataFrame) -> None:
        """The new rows in place of those of the same nodes."""
        rows = pd.concat([x for x in (before[~before.index.isin(new.index)], new) if len(x)]).reset_index()
        rows, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_table(rows)
        self.value.update((self.buckets, sink.getvalue().to_pybytes()))

    def close(self) -> None:
        pass


class Digests(Bucketed):
    """Of each node's rows, by seq, those whose digest differs from the one before; rows that mark a node clean pass."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.read(["node_id", "digest"])
        every = pd.concat(list(rows)).sort_values(["node_id", "seq", "digest"], kind="stable")
        clean = every["clean"].to_numpy(bool)
        contents = every[~clean]
        before = contents.groupby("node_id", sort=False)["digest"].shift()
        first = before.isna()
        before = before.where(~first, contents["node_id"].map(known["digest"]))
        red = contents[(before.notna() & (before != contents["digest"])).to_numpy(bool)]
        if len(contents):
            self.keep(known, contents.drop_duplicates("node_id", keep="last").set_index("node_id")[["digest"]])
        reds = red.groupby("node_id", sort=False)["seq"].agg(list).rename("reds")
        cleans = every[clean].groupby("node_id", sort=False)["seq"].agg(list).rename("cleans")
        out = pd.concat([reds, cleans], axis=1).rename_axis("node_id").reset_index()
        if len(out):
            yield out.astype(object).where(out.notna(), None)


class Flags(Bucketed):
    """Nodes' flags, with the seq at which each last turned: rows that change nothing, or are older, give nothing."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.read(["node_id", "is_dirty", "seq"])
        node, nodes = pd.factorize((every := pd.concat(list(rows)))["node_id"])
        flat = []
        for column in ("reds", "cleans"):
            lists = [() if x is None else x for x in every[column]]
            sizes = [len(x) for x in lists]
            flat.append((np.repeat(node, sizes), np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64), np.full(sum(sizes), column == "cleans")))
        of, seq, clean = (np.concatenate(x) for x in zip(*flat))
        at = state.index.get_indexer(nodes)
        dirty = np.zeros(len(nodes), bool)
        last = np.full(len(nodes), np.iinfo(np.int64).min)
        dirty[at >= 0] = state["is_dirty"].to_numpy(bool)[at[at >= 0]]
        last[at >= 0] = state["seq"].to_numpy(np.int64)[at[at >= 0]]
        order = np.lexsort((~clean, seq, of))
        order = order[seq[order] >= last[of[order]]]
        of, seq, clean = of[order], seq[order], clean[order]
        # after each row the flag is what the row says, so it turns where rows differ
        first = np.ones(len(of), bool)
        first[1:] = of[1:] != of[:-1]
        turned = np.where(first, dirty[of] == clean, np.append(False, clean[1:] != clean[:-1])[: len(of)])
        if turned.any():
            out = pd.DataFrame({"node_id": nodes[of[turned]], "is_dirty": ~clean[turned], "seq": seq[turned]})
            self.keep(state, out.drop_duplicates("node_id", keep="last").set_index("node_id"))
            yield out


@contextmanager
def state_store(spark: SparkSession):
    """The state store that these operators need, for streams that are started inside; the session's own setting returns after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def affected(nodes: DataFrame, edges: DataFrame, depth: int = 3, origins: DataFrame | None = None) -> DataFrame:
    """(origin, node_id): each known node with itself and its dependents within `depth` edges. Write it to a table before a stream joins it.

    origins(node_id): the known nodes that changes can name, if those aren't all.
    """
    seeds = (nodes if origins is None else origins).select(F.col("node_id").alias("seed")).distinct()
    every = graph.reach(edges, seeds, depth, reverse=True).unionByName(seeds.select("seed", F.col("seed").alias("node_id")))
    return every.distinct().join(nodes.select("node_id").distinct(), "node_id", "left_semi").select(F.col("seed").alias("origin"), "node_id")


def buckets_for(reached: DataFrame) -> int:
    """A number of buckets for affected()'s table. It stays what it is for a checkpoint's life."""
    return max(BUCKETS, reached.count() // BUCKET)


def turns(changes: DataFrame, reached: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of changes(node_id, content, seq, clean) and affected()'s table -> a stream of (node_id, is_dirty, seq): each turn of a flag.

    Null contents have a digest of their own; rows without a node or seq are left out; a node that no edge and no table
    names makes nothing dirty. seq orders a node's changes; equal ones are taken by digest. A stream that goes on from a
    checkpoint needs the number of buckets that it began with.
    """
    bucket = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(buckets))).groupBy("bucket")
    rows = changes.where("node_id is not null and seq is not null")
    rows = rows.select("node_id", F.sha2(F.coalesce("content", F.lit("\0")), 256).alias("digest"), "seq", F.coalesce("clean", F.lit(False)).alias("clean"))
    red = bucket(rows).transformWithStateInPandas(Digests(buckets), _RED, "append", "none")
    spread = red.join(reached.withColumnRenamed("node_id", "other"), F.col("node_id") == F.col("origin"))
    named = spread.select(F.col("other").alias("node_id"), "reds", F.when(F.col("other") == F.col("origin"), F.col("cleans")).alias("cleans"))
    named = named.where("reds is not null or cleans is not null")
    return bucket(named).transformWithStateInPandas(Flags(buckets), TURNS, "append", "none")


def follow(changes: DataFrame, reached: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Takes what is new in the stream and adds the turns of flags to the table `out`, then ends."""
    with state_store(changes.sparkSession):
        query = turns(changes, reached, buckets).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()


def dirty(spark: SparkSession, out: str) -> DataFrame:
    """(node_id, since): the nodes whose flag stands now."""
    last = spark.read.schema(TURNS).parquet(out).groupBy("node_id").agg(F.max(F.struct("seq", "is_dirty")).alias("t"))
    return last.where("t.is_dirty").select("node_id", F.col("t.seq").alias("since"))
