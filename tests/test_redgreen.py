"""The stateful stream of dirty flags, stopped and started again, against the batch form."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkwright.functions.ordering import written
from sparkwright.operators import graph
from sparkwright.streaming import redgreen


def put(spark, rows, folder):
    spark.createDataFrame(rows, redgreen.CHANGES).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)


def stream(spark, folder):
    return spark.readStream.schema(redgreen.CHANGES).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(scope="module")
def network(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "z")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcdexyz"], "node_id string")
    return nodes, edges, written(redgreen.affected(nodes, edges, 3), "affected")


def test_affected_is_the_batch_form(spark, network):
    nodes, edges, reached = network
    for n in "abcdexyz":
        got = {r.node_id for r in reached.where(F.col("origin") == n).collect()}
        assert got == {r.node_id for r in graph.mark_dirty(nodes, edges, spark.createDataFrame([(n,)], "node_id string"), 3).collect()}


def test_flags_over_restarts(spark, network, tmp_path):
    _, _, reached = network
    folder, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    state = lambda: {r.node_id: r.since for r in redgreen.dirty(spark, out).collect()}
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    put(spark, [("a", "one", 1, None), ("x", None, 1, False), ("unknown", "u", 1, False), (None, "n", 2, False), ("c", "c1", None, False)], folder)
    redgreen.follow(stream(spark, folder), reached, out, mark)
    assert state() == {}  # first contents are what is known, not changes
    put(spark, [("a", "one", 2, False), ("x", None, 2, False)], folder)
    redgreen.follow(stream(spark, folder), reached, out, mark)
    assert state() == {}
    put(spark, [("a", "two", 3, False), ("unknown", "v", 3, False)], folder)
    redgreen.follow(stream(spark, folder), reached, out, mark)
    assert state() == {"a": 3, "b": 3, "c": 3, "d": 3}
    put(spark, [("b", None, 4, True), ("a", "three", 5, False), ("x", "", 5, False)], folder)
    put(spark, [("d", None, 6, True)], folder)
    redgreen.follow(stream(spark, folder), reached, out, mark)
    assert state() == {"a": 3, "b": 5, "c": 3, "x": 5, "y": 5}
    before = spark.read.parquet(out).count()
    redgreen.follow(stream(spark, folder), reached, out, mark)
    assert spark.read.parquet(out).count() == before
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_a_stream_in_parts_is_the_batch(spark, network, tmp_path):
    nodes, edges, reached = network
    rng = random.Random(3)
    rows = [(rng.choice("abcdexyz"), rng.choice(["p", "p", "p", "q"]), i, False) for i in range(25)]
    folder, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    for at in range(0, len(rows), 9):
        put(spark, rows[at : at + 9], folder)
        redgreen.follow(stream(spark, folder), reached, out, mark)
    last, changed = {}, set()
    for n, c, _, _ in rows:
        if last.get(n, c) != c:
            changed.add(n)
        last[n] = c
    want = graph.mark_dirty(nodes, edges, spark.createDataFrame([(n,) for n in changed], "node_id string"), 3)
    assert {r.node_id for r in redgreen.dirty(spark, out).collect()} == {r.node_id for r in want.collect()}


def plain_turns(batches, reached):
    """The same row by row: batch after batch first the digests, then the flags."""
    known, flags, out = {}, {}, []
    digest = lambda c: hashlib.sha256((c if c is not None else "\0").encode()).hexdigest()
    for rows in batches:
        named = []
        for n, seq, d, clean in sorted((n, seq, digest(c), bool(clean)) for n, c, seq, clean in rows):
            if clean:
                named += [(n, seq, True)] if n in reached.get(n, ()) else []
                continue
            if known.get(n, d) != d:
                named += [(m, seq, False) for m in reached.get(n, ())]
            known[n] = d
        for n, seq, clean in sorted(named, key=lambda r: (r[0], r[1], not r[2])):
            dirty, last = flags.get(n, (False, None))
            if dirty == clean and (last is None or seq >= last):
                flags[n] = (not clean, seq)
                out.append((n, not clean, seq))
    return sorted(out)


def test_states_are_by_bucket_and_turns_those_of_single_rows(spark, tmp_path):
    """Thousands of nodes take a row of the store for each bucket; late rows, equal seqs and clean marks turn flags as they do one by one."""
    rng = random.Random(8)
    names = [f"n{i}" for i in range(2000)]
    pairs = [(n, n) for n in names] + [(f"n{i}", f"n{i // 2}") for i in range(1, 2000)]
    reached = spark.createDataFrame(pairs, "origin string, node_id string")
    batches = [[(rng.choice(names[:400] if k else names), rng.choice(["p", "q", None]), rng.randrange(900), rng.random() < 0.2) for _ in range(3000)] for k in range(2)]
    folder, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    for rows in batches:
        put(spark, rows, folder)
        redgreen.follow(stream(spark, folder), reached, out, mark, 8)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == plain_turns(batches, near)
    for operator in (0, 1):
        store = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "bucket")
        with redgreen.state_store(spark):
            assert store.load(mark).count() == 8
    put(spark, batches[0], folder)
    with pytest.raises(Exception, match="states have 8 buckets, not 4"):
        redgreen.follow(stream(spark, folder), reached, out, mark, 4)
