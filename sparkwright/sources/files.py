"""Source trees, texts, configuration and checkpoints."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes by language.
SUFFIXES = {"python": (".py",), "typescript": (".ts", ".tsx", ".js", ".jsx")}


@dataclass(frozen=True)
class Config:
    """Settings and their defaults."""

    languages: tuple[str, ...] = ("python", "typescript")
    exclude_patterns: tuple[str, ...] = ()
    max_file_size_mb: float = 1.0
    max_memory_gb: float = 26.0
    batch_size: int = 10
    rrf_k: int = 60
    nprobe: int = 64
    min_chunk_lines: int = 5
    extra: dict = field(default_factory=dict)


def load_config(path: str | None = None) -> Config:
    """A YAML or JSON file of settings; without one the defaults. Unknown names go to `extra`."""
    if path is None or not os.path.exists(path):
        return Config()
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    found = found or {}
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in Config.__dataclass_fields__ and k != "extra"}
    return Config(**known, extra={k: v for k, v in found.items() if k not in known})


def load_prompt(folder: str, name: str) -> str:
    with open(os.path.join(folder, name if name.endswith(".txt") else f"{name}.txt")) as f:
        return f.read()


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """A line of an ignore file -> (regular expression for a path relative to the root, whether it excludes). None for blanks and comments."""
    line = line.rstrip("\n").rstrip("\r")
    line = line if line.endswith("\\ ") else line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    excludes = not line.startswith("!")
    line = line[1:] if not excludes else line[1:] if line.startswith(("\\#", "\\!")) else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, at = "", 0
    while at < len(line):
        c = line[at]
        if line.startswith("**/", at) and (at == 0 or line[at - 1] == "/"):
            out, at = out + "(?:[^/]+/)*", at + 3
        elif line[at:] == "**" and at and line[at - 1] == "/":
            out, at = out + ".+", at + 2
        elif c == "*":
            out, at = out + "[^/]*", at + (2 if line.startswith("**", at) else 1)
        elif c == "?":
            out, at = out + "[^/]", at + 1
        elif c == "[" and "]" in line[at + 2 :]:
            end = line.index("]", at + 2)
            body = line[at + 1 : end]
            out, at = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and at + 1 < len(line):
            out, at = out + re.escape(line[at + 1]), at + 2
        else:
            out, at = out + re.escape(c), at + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), excludes


def ignored(path, lines: list[str]):
    """Whether a relative path is excluded: the last pattern that matches decides."""
    out = F.lit(False)
    for found in map(ignore_pattern, lines):
        if found:
            out = F.when(path.rlike(found[0]), F.lit(found[1])).otherwise(out)
    return out


def root_ignore_lines(root: str) -> list[str]:
    """Of the root's ignore file only; none if it can't be read."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            return f.read().splitlines()
    except (OSError, UnicodeDecodeError):
        return []


def language_of(path):
    suffix = F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))
    out = F.lit(None).cast("string")
    for name, ends in SUFFIXES.items():
        out = F.when(suffix.isin(*ends), F.lit(name)).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, config: Config | None = None, ignore_lines: list[str] | None = None) -> DataFrame:
    """(path, file, language, length, content): files of the languages, not larger than the limit, not ignored. Contents are read last."""
    config = config or Config()
    lines = (root_ignore_lines(root) if ignore_lines is None else ignore_lines) + list(config.exclude_patterns)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    start = "file:" + os.path.abspath(root) if "://" not in root else root
    file = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "file:/"), "^" + re.escape(start.rstrip("/")) + "/", "")
    out = found.withColumn("file", file).withColumn("language", language_of(F.col("file")))
    wanted = F.col("language").isin(*config.languages) & (F.col("length") <= int(config.max_file_size_mb * 1024 * 1024))
    return out.where(wanted).where(~ignored(F.col("file"), lines)).select("path", "file", "language", "length", "content")


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    """(path, error): files of the tree that can be listed but not read; scans of such a tree should set
    spark.sql.files.ignoreCorruptFiles and ignoreMissingFiles, or those files end them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    found = reader.load(root)
    read = found.where(F.length("content") >= 0).select("path")
    return found.select("path").join(read, "path", "left_anti").withColumn("error", F.lit("unreadable"))


def by_extension(files: DataFrame, extensions: tuple[str, ...] = (".py",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """files(file, ...) whose path ends in one of the extensions and matches none of the patterns. A pattern is held against
    the last parts of the path, as many as it has, below a root of any name; in it * and ** stand for anything within one part.
    """
    wanted, dropped = F.lit(False), F.lit(False)
    for e in extensions:
        wanted = wanted | F.col("file").endswith(e)
    for p in exclude:
        parts = "/".join("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", x)) for x in p.strip("/").split("/"))
        dropped = dropped | F.concat(F.lit("/"), "file").rlike(f"(^|/){parts}$")
    return files.where(wanted & ~dropped)


def texts(files: DataFrame) -> DataFrame:
    """files(..., content) with text; null where the bytes are no UTF-8."""
    return files.withColumn("text", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")))


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, summary) of a JSON object; empty if it is missing or no object."""
    rows = []
    try:
        with open(path) as f:
            found = json.load(f)
        rows = [(k, str(v)) for k, v in found.items()] if isinstance(found, dict) else []
    except (OSError, ValueError):
        pass
    return spark.createDataFrame(rows, "node_id string, summary string")
