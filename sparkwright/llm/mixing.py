"""Mixing sources to target weights by balanced sampling with the cube method.

A source of rate r = target / size takes each document floor(r) times, and once more with
probability r - floor(r). The choices are made by the cube method: a vector of probabilities moves
within the null-space of the balancing constraints, here the totals of words and of documents, and
each step brings one probability to 0 or 1. With two constraints three undecided documents are
enough for a step. Blocks of a source's documents fly on their own and leave two undecided documents
at most; those of many blocks fly together in the next round, and so on until one block is left. There a dozen
documents of all sizes are held back, and they and the last two undecided ones are the landing
problem: of all ways to decide them the best balanced one is taken. Random numbers come from ids, so
reruns agree.
"""

from __future__ import annotations

from itertools import cycle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.ordering import numbered, running_sums
from sparkwright.llm.common import col, stored

WEIGHTS = (1, 2, 3)
LIMIT = 3
BLOCK = 4096
RESERVE = 12
#: Beyond so many sources their totals don't come to the driver, and are joined by shuffle.
COLLECTED_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
EDGE = 1e-9


def targets(sizes: list[int], weights: list[float], limit: float = LIMIT) -> list[float]:
    """Shares by weight of the total size, none above `limit` times its size; what is cut is shared out again by weight."""
    left, total = set(range(len(sizes))), float(sum(sizes))
    out = [0.0] * len(sizes)
    while left:
        weight = sum(weights[i] for i in sorted(left))
        above = [i for i in sorted(left) if total * weights[i] / weight > limit * sizes[i]]
        if not above:
            for i in left:
                out[i] = total * weights[i] / weight
            break
        for i in above:
            out[i] = float(limit * sizes[i])
            total -= out[i]
            left.discard(i)
    return out


def flight(p: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Moves probabilities p until two documents at most are undecided, all totals of p and p * size kept.

    draws: random numbers from 0 to 1, one for each document.
    """
    p = p.copy()
    waiting: list[int] = []
    for k in range(len(p)):
        if p[k] < EDGE or p[k] > 1 - EDGE:
            p[k] = round(p[k])
            continue
        waiting.append(k)
        if len(waiting) < 3:
            continue
        a, b, c = (float(sizes[i]) for i in waiting)
        u = [b - c, c - a, a - b]  # keeps the sum of p and the sum of p * size
        top = max(map(abs, u))
        u = [x / top for x in u] if top else [1.0, -1.0, 0.0]
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(waiting, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(waiting, u) if v)
        move = up if float(draws[k]) * (up + down) < down else -down
        for i, v in zip(waiting, u):
            q = p[i] + move * v
            p[i] = 0.0 if q < EDGE else 1.0 if q > 1 - EDGE else q
        waiting = [i for i in waiting if 0.0 < p[i] < 1.0]
    return p


def land(p: np.ndarray, sizes: np.ndarray, draws: np.ndarray, reserve: int = RESERVE) -> np.ndarray:
    """Decides all: a few documents of all sizes are held back from the flight; of all ways to decide them and
    what the flight leaves, the one that keeps the totals of words and documents best is taken."""
    (undecided,) = np.nonzero((p >= EDGE) & (p <= 1 - EDGE))
    by_size = undecided[np.lexsort((draws[undecided], sizes[undecided]))]
    held = by_size[np.unique(np.linspace(0, len(by_size) - 1, min(reserve, len(by_size))).round().astype(int))] if len(by_size) else by_size
    flying = np.ones(len(p), bool)
    flying[held] = False
    p = p.copy()
    p[flying] = flight(p[flying], sizes[flying], draws[flying])
    (rest,) = np.nonzero((p >= EDGE) & (p <= 1 - EDGE))
    ways = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest)) & 1).astype(float)
    off = ways - p[rest]
    cost = np.abs(off @ sizes[rest]) / max(1.0, float(sizes.mean())) + 0.05 * np.abs(off.sum(1))
    p[rest] = ways[int(cost.argmin())]
    return p.round()


def _fly(landing: bool):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "doc_id", "h"], kind="stable", na_position="first")
        return pdf.drop(columns="blk").assign(p=(land if landing else flight)(pdf["p"].to_numpy(float), pdf["size"].to_numpy(float), pdf["draw"].to_numpy()))

    return work


def decisions(units: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """units(doc_id, h, source_no, size, floor, p) -> the same, p decided to 0 or 1. most: units of the largest source."""
    schema = "doc_id bigint, h bigint, source_no int, size double, floor bigint, p double, draw double"
    draw = F.pmod(F.xxhash64("doc_id", "h", F.lit("draw")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    left, done = units.withColumn("draw", draw), None
    whole = "p <= 0 or p >= 1"
    done, left = left.where(whole), left.where(f"not ({whole})")
    key = F.xxhash64("doc_id", "h", F.lit("block"))
    while True:
        blocks = -(-most // block)
        own = left.withColumn("blk", F.pmod(key, F.lit(blocks)).cast("int"))
        flown = own.groupBy("source_no", "blk").applyInPandas(_fly(blocks <= 1), schema)
        if blocks <= 1:
            return done.unionByName(flown)
        flown = stored(flown, "flight")
        done, left = done.unionByName(flown.where(whole)), flown.where(f"not ({whole})")
        most = 2 * blocks


def _targets_by_shuffle(sums: DataFrame, weights: tuple, limit: float) -> DataFrame:
    """sums(source, size, n) -> (source_no, source, source_size, target, rate) where there are too many sources for the driver: as targets(), a round of it a job."""
    placed = numbered(sums.withColumn("last", F.col("source").isNull()), ["last", "source"]).withColumnRenamed("place", "source_no")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("source_no") % len(weights) + 1).cast("int"))
    left = stored(placed.select("source_no", "source", F.col("size").alias("source_size"), weight.alias("weight"), F.lit(None).cast("double").alias("target")), "sources")
    total = float(left.agg(F.sum("source_size")).first()[0])
    while True:
        open_weight = left.where("target is null").agg(F.sum("weight")).first()[0]
        if not open_weight:
            break
        share, cap = F.lit(total) * F.col("weight") / F.lit(open_weight), F.lit(float(limit)) * F.col("source_size")
        after = stored(left.withColumn("capped", F.col("target").isNull() & (share > cap)).withColumn("target", F.when(F.col("capped"), cap).otherwise(F.col("target"))), "sources")
        cut_off = after.where("capped").agg(F.sum("target")).first()[0]
        left = after.drop("capped")
        if cut_off is None:
            left = left.withColumn("target", F.coalesce("target", share))
            break
        total -= cut_off
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return stored(left.select(F.col("source_no").cast("int").alias("source_no"), "source", "source_size", "target", rate.alias("rate")), "sources")


def _plan(units: DataFrame, weights: tuple, limit: float) -> tuple[DataFrame, int]:
    """(source_no, source, source_size, target, rate) of each source, and the units of the largest one."""
    spark = units.sparkSession
    sums = stored(units.groupBy("source").agg(F.sum(F.col("one") * F.col("rows")).alias("size"), F.count("*").alias("n")), "sums")
    sources, most = sums.agg(F.count("*"), F.max("n")).first()
    if sources > COLLECTED_SOURCES:
        return _targets_by_shuffle(sums, weights, limit), most
    rows = sorted(sums.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["size"] for r in rows], [w for w, _ in zip(cycle(weights), rows)], limit)
    plan = [(i, r["source"], r["size"], g, g / r["size"] if r["size"] else 0.0) for i, (r, g) in enumerate(zip(rows, goal))]
    return F.broadcast(spark.createDataFrame(plan, "source_no int, source string, source_size bigint, target double, rate double")), most or 1


def _units(docs: DataFrame, weights: tuple, limit: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows' own columns, and the units: one for each distinct id, text and source, with its rows, and how many copies all of them take."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    own = own.select("doc_id", "source", F.xxhash64("text").alias("h"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"))
    own = stored(own, "sizes")
    units = stored(own.groupBy("doc_id", "h", "source").agg(F.first("size").alias("one"), F.count("*").alias("rows")), "units")
    plan, most = _plan(units, weights, limit)
    joined = units.join(plan, units.source.eqNullSafe(plan.source)).drop(units.source)
    # n equal rows take n * rate copies: the whole part surely, what is left as one document
    wanted = F.col("rate") * F.col("rows")
    whole = F.floor(wanted + EDGE)
    units = joined.select("doc_id", "h", "source_no", "source", "rows", "source_size", "target", F.col("one").cast("double").alias("size"), whole.alias("floor"), F.greatest(wanted - whole, F.lit(0.0)).alias("p"))
    units = stored(units, "chances")
    chosen = decisions(units.select("doc_id", "h", "source_no", "size", "floor", "p"), most, block)
    chosen = chosen.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("source_no").alias("s"), (F.col("floor") + F.col("p")).cast("bigint").alias("all_copies"))
    both = units.join(chosen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("source_no") == F.col("s")))
    return own, stored(both.select("doc_id", "h", "source", "rows", "source_size", "target", "all_copies"), "chosen")


def _dealt(rows: DataFrame, units: DataFrame, order: list[str]) -> DataFrame:
    """rows(_d, _h, _s, ...) with their unit's columns and `copies`: a unit's copies fall evenly on its rows, what is over on the first ones in order."""
    keys = ["_d", "_h", "_s"]
    both = rows.join(units, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")) & F.col("_s").eqNullSafe(F.col("source"))).drop("h").drop(units.doc_id).drop(units.source)
    alone = both.where("rows = 1").withColumn("copies", F.col("all_copies"))
    if units.where("rows > 1").isEmpty():
        return alone
    placed = running_sums(both.where("rows > 1").withColumn("_one", F.lit(1)), keys, order, "_one", "_place").drop("_one")
    more = F.col("_place") < F.col("all_copies") % F.col("rows")
    return alone.unionByName(placed.withColumn("copies", F.floor(F.col("all_copies") / F.col("rows")) + more.cast("bigint")).drop("_place"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, source, ...) -> one row for each input row: doc_id, h, source, size, source_size, target, taken, copies.

    size counts the words between ASCII white space (null text: 0); sources by code point, null last, weigh
    `weights` in turn; taken is size times the copies that the mix takes, `limit` at most. Of n rows of equal id,
    text and source some may be taken once more than others: together they take what one document n times as
    likely would. A source without words has target 0 and takes nothing; an empty table gives no row; null ids are
    ids like any other; further columns are ignored. Up to COLLECTED_SOURCES sources their totals come to
    the driver, a row for each; more are worked out by shuffles.
    """
    own, units = _units(docs, weights, limit, block)
    rows = own.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("source").alias("_s"), "size")
    out = _dealt(rows, units, ["size"])
    return out.select(F.col("_d").alias("doc_id"), F.col("_h").alias("h"), F.col("_s").alias("source"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """docs as the mix takes them: each row as often as chosen, all columns kept. Of rows of equal id, text and source those of the smallest XXH64 of all columns come first."""
    _, units = _units(docs, weights, limit, block)
    names = [f"k{i}" for i in range(len(docs.columns))]
    own = docs.select(*(col(c).alias(n) for c, n in zip(docs.columns, names)), F.col("doc_id").cast("bigint").alias("_d"), F.xxhash64(F.col("text").cast("string")).alias("_h"), F.col("source").cast("string").alias("_s"))
    own = own.withColumn("_x", F.xxhash64(*names))
    repeated = _dealt(own, units, ["_x"]).where("copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return repeated.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))
