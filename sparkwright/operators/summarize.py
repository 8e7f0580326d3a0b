"""Summaries in batches: prompts, calls to a pluggable generator, parsing, validation, quality, memory.

A generator is a callable from prompt to response. It travels to the executors, so a client should be
made inside it. The default, `echo_generator`, is a deterministic stand-in without a network.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from string import Template

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwright.functions import text as T
from sparkwright.functions.batches import bounded_batches
from sparkwright.functions.ordering import numbered, written

Generator = Callable[[str], str]

# The ids, names, types and variables of the prompts that are there from the start; the texts are this engine's own.
DEFAULT_PROMPTS = (
    ("code_abstractive", "Code Abstractive Summary", "abstractive", ["code", "context"], "Say in a few sentences what this code is for.\n\nContext: ${context}\n\nCode:\n${code}\n"),
    ("code_extractive", "Code Extractive Summary", "extractive", ["code"], "List the lines of this code that matter most.\n\nCode:\n${code}\n"),
    ("code_hierarchical", "Hierarchical Code Summary", "hierarchical", ["code", "file_path"], "Summarise ${file_path} from its parts up.\n\nCode:\n${code}\n"),
    ("function_doc", "Function Documentation", "abstractive", ["code"], "Write a docstring for this function.\n\nCode:\n${code}\n"),
)
DEFAULT_FOR_TYPE = {"abstractive": "code_abstractive", "extractive": "code_extractive", "hierarchical": "code_hierarchical"}
PHASES = ("batch_start", "llm_call_start", "llm_call_success", "llm_call_error", "node_validated", "node_invalid", "batch_done", "disabled")
#: The error of a batch that was not called, as the run was disabled.
DISABLED = "disabled"


@dataclass
class Prompt:
    id: str
    name: str
    template: str
    summary_type: str
    description: str = ""
    variables: list[str] = field(default_factory=list)
    version: str = "1.0"


class PromptRegistry:
    def __init__(self) -> None:
        self.prompts = {i: Prompt(i, name, text, kind, name, list(variables)) for i, name, kind, variables, text in DEFAULT_PROMPTS}

    def register(self, prompt: Prompt) -> None:
        self.prompts[prompt.id] = prompt

    def get(self, prompt_id: str) -> Prompt:
        return self.prompts[prompt_id]

    def delete(self, prompt_id: str) -> bool:
        return self.prompts.pop(prompt_id, None) is not None

    def list(self, summary_type: str | None = None) -> list[Prompt]:
        return [p for p in self.prompts.values() if summary_type in (None, p.summary_type)]

    def render(self, prompt_id: str, **variables) -> str:
        """KeyError for an unknown prompt, ValueError for a missing variable; unknown names in the template stay."""
        prompt = self.get(prompt_id)
        missing = [v for v in prompt.variables if v not in variables]
        if missing:
            raise ValueError(f"missing variables: {', '.join(missing)}")
        return Template(prompt.template).safe_substitute(variables)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p.id, p.name, p.template, p.summary_type, p.description, p.variables, p.version) for p in self.prompts.values()]
        return spark.createDataFrame(rows, "id string, name string, template string, summary_type string, description string, variables array<string>, version string")


def default_prompt(summary_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in DEFAULT_FOR_TYPE.items() for x in kv))
    return F.coalesce(F.try_element_at(table, summary_type), F.lit("code_abstractive"))


def rendered(template: str, **columns: Column) -> Column:
    """A template with columns for its variables; null counts as empty."""
    out = F.lit(template)
    for name, value in columns.items():
        out = F.replace(out, F.lit("${" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def batches(rows: DataFrame, order: list[str], size: int = 10) -> DataFrame:
    """rows with batch = their place in order, from 0, by size."""
    return numbered(rows, order).withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def component(node_id: Column, kind: Column, name: Column, file: Column, source: Column, docstring: Column, parents: Column, children: Column) -> Column:
    """One component's part of a batch prompt."""
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    names = lambda label, xs: F.when(F.size(xs) > 0, F.concat(F.lit(label), F.array_join(F.slice(xs, 1, 5), ", ")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Component ID: ["), node_id, F.lit("]")), F.concat(F.lit("Type: "), known(kind)), F.concat(F.lit("Name: "), known(name)), F.concat(F.lit("File: "), known(file)),
        F.when(docstring != "", F.concat(F.lit("Docstring: "), docstring)), F.concat(F.lit("Source Code:\n"), F.coalesce(source, F.lit(""))),
        names("Called by: ", parents), names("Calls: ", children), F.lit("\n---\n"),
    )


PROMPT_HEAD = "Summarise each of the components below.\nAnswer in the form: [COMPONENT_ID] <summary>\n\n---\n"


def parse_response(response: str, ids: list[str]) -> dict[str, str]:
    """A line that holds [id] begins that id's summary (the first such id in the list); other lines go on; an id that returns starts anew."""
    out: dict[str, list[str]] = {}
    current = None
    for line in response.split("\n"):
        found = next((i for i in ids if f"[{i}]" in line), None)
        if found is not None:
            current, line = found, line.replace(f"[{found}]", "")
            out[current] = []
        if current is not None and line.strip():
            out[current].append(line.strip())
    return {k: " ".join(v) for k, v in out.items() if v}


def segments(lines: DataFrame, group: str, order: str, text: str, marker: str = r"\[([^\]]+)\]") -> DataFrame:
    """Lines of many responses: each belongs to the last marker before it; (group, id, summary)."""
    seen = F.regexp_extract(text, marker, 1)
    own = lines.withColumn("_seen", F.when(seen != "", seen))
    own = own.withColumn("id", F.last("_seen", ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    bare = F.trim(F.regexp_replace(text, marker, ""))
    kept = own.where("id is not null").withColumn("_line", bare).where("_line <> ''")
    parts = kept.groupBy(group, "id").agg(F.array_sort(F.collect_list(F.struct(order, "_line"))).alias("_parts"))
    return parts.select(group, "id", F.array_join(F.transform("_parts", lambda x: x["_line"]), " ").alias("summary"))


def validity(summary: Column, name: Column, least: int = 50) -> Column:
    """(valid, confidence): too short (false, 0), without the name (true, 0.5), else (true, 1)."""
    one = lambda ok, x: F.struct(F.lit(ok).alias("valid"), F.lit(x).alias("confidence"))
    return F.when(F.length(summary) < least, one(False, 0.0)).when(~F.contains(summary, name), one(True, 0.5)).otherwise(one(True, 1.0))


def quality(summary: Column, original: Column) -> Column:
    """Under 20 characters 0.3; longer than the original 0.4; equal to it but for outer white space 0.2; under 5 words 0.4; else up to 0.9 with the words."""
    n = F.size(T.words(summary))
    return (
        F.when(F.length(summary) < 20, 0.3).when(F.length(summary) > F.length(original), 0.4).when(T.strip(summary) == T.strip(original), 0.2)
        .when(n < 5, 0.4).otherwise(F.least(F.lit(0.9), F.lit(0.5) + n / F.lit(100)))
    )


def tokens_used(prompt: Column, response: Column) -> Column:
    return F.floor(F.length(prompt) / 4) + F.floor(F.length(response) / 4)


def echo_generator(prompt: str) -> str:
    """A stand-in for a language model: for each component a sentence with its name and its first line."""
    parts = re.findall(r"Component ID: \[([^\]]+)\]\nType: (\S+)\nName: (\S+)[\s\S]*?Source Code:\n([^\n]*)", prompt)
    if not parts:
        return " ".join(prompt.split()[:60])
    return "\n".join(f"[{i}] The {kind} {name} is defined by the line: {line.strip()} and is summarised by its text." for i, kind, name, line in parts)


def pending(nodes: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes that the checkpoint `done` doesn't name."""
    return nodes.join(done.select("node_id"), "node_id", "left_anti")


def with_attributes(summaries: DataFrame, nodes: DataFrame) -> DataFrame:
    """summaries(node_id, summary) with the nodes' type, name and file, empty for unknown nodes."""
    own = nodes.select("node_id", "type", "name", "file")
    out = summaries.join(own, "node_id", "left")
    return out.select("node_id", "summary", *(F.coalesce(c, F.lit("")).alias(c) for c in ("type", "name", "file")))


def run(nodes: DataFrame, store, generator: Generator = echo_generator, batch_size: int = 10, cadence: int = 100, table: str = "summaries") -> DataFrame:
    """Summaries of all nodes into a table of the store, by waves of `cadence` batches; returns the event log of progress().

    Waves go by steps, one wave at first, then as many as are done: so what adding to the table costs grows with the run's size
    and not with its square. A step's results are added before the next one starts, so a run that ends early is taken up
    there and has lost half of its work at most. A connection error (the generator raises
    ConnectionError) disables the run: no later step starts, the task that met it makes no call for later waves, and each
    batch that was not called has an event `disabled`. Other errors cost their own batch only.
    """
    spark = nodes.sparkSession
    known = store.read(table)
    todo = nodes if known is None else pending(nodes, known)
    placed = written(numbered(_parts(todo), ["node_id"]).withColumn("batch", F.floor(F.col("place") / batch_size)).drop("place"), "todo")
    total, done, results, skipped = -(-placed.count() // batch_size), 0, [], []
    while done < total:
        end = min(total, done + max(1, done // cadence) * cadence)
        made = written(_called(placed.where((F.col("batch") >= done) & (F.col("batch") < end)), generator, cadence), "wave")
        store.upsert(table, made.where("node_id is not null").select("node_id", "summary", "valid", "confidence"), ["node_id"])
        results.append(made.where(F.col("error").isNull() | (F.col("error") != DISABLED)))
        skipped.append(made.where(F.col("error") == DISABLED).select("batch"))
        done = end
        if not made.where("error like 'Connection%'").isEmpty():
            break
    if not results:
        return spark.createDataFrame([], "batch bigint, phase string, node_id string, message string")
    left = reduce(DataFrame.unionByName, skipped).unionByName(spark.range(done, total).select(F.col("id").alias("batch")))
    left = left.select("batch", F.lit("disabled").alias("phase"), F.lit(None).cast("string").alias("node_id"), F.lit("connection error").alias("message"))
    return progress(reduce(DataFrame.unionByName, results), batch_size).unionByName(left)


def batch_totals(results: DataFrame) -> DataFrame:
    """memoised()'s rows, with latency_ms if there is one -> one row: items, tokens and latency in total."""
    latency = F.coalesce(F.sum("latency_ms"), F.lit(0.0)) if "latency_ms" in results.columns else F.lit(0.0)
    return results.agg(F.count("*").alias("items"), F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("bigint").alias("tokens"), latency.cast("double").alias("latency_ms"))


def summarize(nodes: DataFrame, generator: Generator = echo_generator, batch_size: int = 10, done: DataFrame | None = None) -> DataFrame:
    """nodes(node_id, type, name, file, source_code, docstring, parents, children) -> (node_id, batch, summary, valid, confidence, error).

    Nodes that `done` names are left out. A batch is one call; what it lacks, and all of a failed call, gives no
    row but one of the batch's error with a null node_id.
    """
    if done is not None:
        nodes = pending(nodes, done)
    return _called(batches(_parts(nodes), ["node_id"], batch_size), generator)


def _parts(nodes: DataFrame) -> DataFrame:
    """(node_id, name, part): each node's part of its batch's prompt."""
    text = component(*(F.col(c) for c in ("node_id", "type", "name", "file", "source_code", "docstring", "parents", "children")))
    return nodes.select("node_id", "name", text.alias("part"))


def _called(rows: DataFrame, generator: Generator, cadence: int | None = None, tasks: int | None = None) -> DataFrame:
    """(node_id, name, part, batch) -> summarize()'s rows. With `cadence` a task that met a connection error makes no call for
    batches of later waves: each gives a row of the error DISABLED. A batch is one row of the nodes that it holds.
    """

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lost: float = np.inf  # the first wave of which this task met a connection error
        for pdf in parts:
            out = []
            for batch, nodes in zip(pdf["batch"].tolist(), pdf["nodes"]):
                wave = batch // cadence if cadence else 0
                if wave > lost:
                    out.append((None, batch, None, None, DISABLED))
                    continue
                ids = [x["node_id"] for x in nodes]
                try:
                    found = parse_response(generator(PROMPT_HEAD + "\n".join(x["part"] for x in nodes)), ids)
                    out += [(x["node_id"], batch, x["name"], found[x["node_id"]], None) for x in nodes if x["node_id"] in found]
                except Exception as e:  # whatever a client raises
                    out.append((None, batch, None, None, f"{type(e).__name__}: {e}"))
                    if out[-1][4].startswith("Connection"):
                        lost = min(lost, wave)
            yield pd.DataFrame(out, columns=["node_id", "batch", "name", "summary", "error"])

    dealt = rows.repartition(tasks or rows.sparkSession.sparkContext.defaultParallelism, "batch")
    each = dealt.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("node_id", "name", "part"))).alias("nodes")).sortWithinPartitions("batch")
    made = each.mapInPandas(work, "node_id string, batch bigint, name string, summary string, error string")
    v = validity(F.col("summary"), F.coalesce("name", F.lit("")))
    return made.withColumn("v", F.when(F.col("summary").isNotNull(), v)).select("node_id", "batch", "summary", "v.valid", "v.confidence", "error")


def progress(results: DataFrame, batch_size: int = 10) -> DataFrame:
    """summarize()'s rows as an event log: (batch, phase, node_id, message), by batch in the order of PHASES."""
    event = lambda df, phase, node, message: df.select("batch", F.lit(phase).alias("phase"), node.cast("string").alias("node_id"), message.cast("string").alias("message"))
    none = F.lit(None)
    by_batch = results.groupBy("batch").agg(F.count("node_id").alias("n"), F.max("error").alias("error"))
    fine, broken = by_batch.where("error is null"), by_batch.where("error is not null")
    told = F.concat(F.col("n").cast("string"), F.lit(f" of up to {batch_size} nodes"))
    parts = [
        event(by_batch, "batch_start", none, none), event(by_batch, "llm_call_start", none, none), event(fine, "llm_call_success", none, none),
        event(broken, "llm_call_error", none, F.col("error")), event(results.where("valid"), "node_validated", F.col("node_id"), none),
        event(results.where("not valid"), "node_invalid", F.col("node_id"), none), event(by_batch, "batch_done", none, told),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def memoised(items: DataFrame, generator: Generator = echo_generator, registry: PromptRegistry | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """items(item_id, content, summary_type, prompt_id) -> results, and the cache with what was new.

    The key is the digest of content, type and prompt; each key is generated once, however often it stands.
    """
    bounded_batches(items.sparkSession)
    registry = registry or PromptRegistry()
    templates = {p.id: p.template for p in registry.list()}
    keyed = items.withColumn("cache_key", T.cache_key(F.col("content"), F.col("summary_type"), F.col("prompt_id"))).withColumn("prompt", F.coalesce("prompt_id", default_prompt(F.col("summary_type"))))
    one = keyed.groupBy("cache_key").agg(F.min(F.struct("content", "prompt")).alias("x")).select("cache_key", "x.*")
    if cache is not None:
        one = one.join(cache, "cache_key", "left_anti")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            asked = [Template(templates[p]).safe_substitute(code=c or "", context="", file_path="") for p, c in zip(pdf["prompt"], pdf["content"])]
            yield pd.DataFrame({"cache_key": pdf["cache_key"], "summary": [generator(x) for x in asked], "n_prompt": [len(x) for x in asked]})

    made = one.mapInPandas(work, "cache_key string, summary string, n_prompt bigint")
    made = made.join(one.select("cache_key", "content"), "cache_key")
    made = made.select("cache_key", "summary", quality(F.col("summary"), F.col("content")).alias("quality_score"), (F.floor(F.col("n_prompt") / 4) + F.floor(F.length("summary") / 4)).alias("tokens_used"))
    every = made if cache is None else cache.unionByName(made)
    known = F.lit(False) if cache is None else F.col("old").isNotNull()
    out = keyed if cache is None else keyed.join(cache.select("cache_key", F.lit(True).alias("old")), "cache_key", "left")
    return out.withColumn("cached", known).join(every, "cache_key").select("item_id", "summary", "quality_score", "tokens_used", "cached"), every
