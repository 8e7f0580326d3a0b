"""License scans: phrases by word position, notices by an exact set-containment join.

Only DataFrame operations run here. One pass splits each text into words once; it keeps their number
and which words of notices and phrases the text has. Only texts whose words suffice for one of them
are read again. There the join is the usual prefix-filtering one, for containment: the tokens of all
notices are ordered by the number of texts that have them in the whole corpus, rarest first. A block
that holds at least a = ceil(t * |T|) of a notice's |T| distinct tokens must hold one of its first
|T| - a + 1 tokens, so only blocks with such a token become candidates (prefix filter), only those
with at least a tokens stay (length filter), and of the tokens from the shared one onwards enough
must be left on both sides (positional filter). What remains is counted in full.

Blocks are lines, of any length, and windows of words: SPREAD times as many consecutive words as the notice has
distinct tokens, wherever they begin. So it doesn't matter how a notice is wrapped, or what blank lines and
comment marks stand in it. A window that holds enough has one that begins with a notice's token and holds as much.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwright.llm.common import ascii_lower, discard, row_key, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices and the labels they add.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)

#: How many times a notice's distinct tokens a window's words are.
SPREAD = 2
#: More texts than this to be read again and they meet their rows by shuffle instead of being sent to each executor.
BROADCAST_DOCS = 500_000
#: More tokens than this and their tables are joined by shuffle instead of being sent to each executor.
BROADCAST_TOKENS = 100_000


def notice_words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in text))))


def _words(low: Column) -> Column:
    return F.filter(F.split(low, GAP), lambda w: w != "")


def _starts(words: Column, phrase: str) -> Column:
    """Positions, from 0, at which the phrase's words stand one after the other."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == p)
        return F.coalesce(hit, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def phrase_places(docs: DataFrame, phrases: tuple = PHRASES) -> DataFrame:
    """docs with `low` -> adds places (one array of starts for each phrase)."""
    none = F.array().cast("array<int>")
    # bound to a lambda variable, so that the words are split once and not for each position
    places = F.transform(F.array(_words(F.col("low"))), lambda words: F.array(*(F.when(F.size(words) > 0, _starts(words, p)).otherwise(none) for p, _ in phrases)))
    return docs.withColumn("places", F.get(places, F.lit(0)))


def _literals(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def first_pass(docs: DataFrame, phrases: tuple, notices: tuple, threshold: float) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, k0, k1, k2, n_words, present, may): the number of words, those of phrases and notices
    among them, and whether they suffice for one of these.

    All letters are lower-cased here, which is quick and never loses a word: it changes no word's bounds, and
    whatever A-Z alone would give is among what it gives.
    """
    tokens = [notice_words(t) for _, t in notices]
    vocabulary = sorted({w for p, _ in phrases for w in p.split()} | {w for t in tokens for w in t})
    words = docs.select("doc_id", *row_key(), F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), GAP).alias("ws"))
    # gaps at the ends leave an empty string there
    count = F.size("ws") - (F.get("ws", F.lit(0)) == "").cast("int") - ((F.size("ws") > 1) & (F.element_at("ws", -1) == "")).cast("int")
    rows = words.select("doc_id", "k0", "k1", "k2", count.cast("bigint").alias("n_words"), F.array_intersect("ws", _literals(vocabulary)).alias("present"))
    may = F.lit(False)
    for p, _ in phrases:
        own = sorted(set(p.split()))
        may = may | (F.size(F.array_intersect("present", _literals(own))) == len(own))
    for own in tokens:
        may = may | (F.size(F.array_intersect("present", _literals(own))) >= int(-(-(len(own) * threshold - 1e-9) // 1)))
    return rows.withColumn("may", may)


def notices_frame(spark: SparkSession, notices: tuple = NOTICES) -> DataFrame:
    """(notice int, label, token), a row for each distinct token of a notice."""
    schema = "notice int, label string, token string"
    rows = [(i, label, w) for i, (label, text) in enumerate(notices) for w in notice_words(text)]
    if not rows:
        return spark.range(0).select(F.lit(0).alias("notice"), F.lit("").alias("label"), F.lit("").alias("token"))
    entries = F.array(*(F.struct(F.lit(i).alias("notice"), F.lit(a).alias("label"), F.lit(w).alias("token")) for i, a, w in rows))
    return spark.range(1).select(F.inline(entries)).to(_schema(schema))


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(text)


def contained(docs: DataFrame, notices: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """docs(k0, k1, k2, low) x notices(notice, label, token) -> (k0, k1, k2, notice, label, containment), a row for each
    line or window and notice whose share of its distinct tokens in there is at least the threshold.
    counts(token, count): how frequent tokens are in the corpus; those that it lacks are the rarest.
    """
    vocabulary = notices.select("token").distinct()
    small = vocabulary.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    sent = F.broadcast if small else (lambda df: df)
    order = vocabulary.join(counts, "token", "left").select("token", F.row_number().over(Window.orderBy(F.coalesce("count", F.lit(0)), "token")).alias("rank"))
    order = stored(order, "token-order")
    ranked = notices.join(order, "token").groupBy("notice", "label").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    ranked = ranked.withColumn("m", F.size("ranks")).withColumn("a", F.ceil(F.col("m") * threshold - 1e-9).cast("int"))
    prefix = ranked.select("*", F.posexplode(F.slice("ranks", F.lit(1), F.col("m") - F.col("a") + 1)).alias("i", "rank"))
    prefix = stored(prefix, "prefix")
    first = prefix.join(order, "rank").select("token").distinct()

    in_lines = _in_lines(docs, order, first, prefix, sent)
    return in_lines.unionByName(_in_windows(docs, order, ranked, prefix, sent))


def _in_lines(docs: DataFrame, order: DataFrame, first: DataFrame, prefix: DataFrame, sent) -> DataFrame:
    """Lines against notices: first (tokens of prefixes) and prefix (of each notice) make the candidates."""
    key = ["k0", "k1", "k2", "line"]
    lines = docs.select("k0", "k1", "k2", F.posexplode(F.split("low", "\n")).alias("line", "text"))
    tokens = lines.select(*key, F.array_distinct(_words(F.col("text"))).alias("tokens"))
    some = tokens.select(*key, "tokens", F.explode("tokens").alias("token")).join(sent(first), "token").select(*key, "tokens").dropDuplicates(key)
    sets = some.select(*key, F.explode("tokens").alias("token")).join(sent(order), "token").groupBy(*key).agg(F.array_sort(F.collect_set("rank")).alias("held"))
    at = sets.select("*", F.posexplode("held").alias("j", "rank"))
    pairs = at.join(sent(prefix), "rank").where(
        (F.size("held") >= F.col("a")) & (F.least(F.col("m") - F.col("i"), F.size("held") - F.col("j")) + F.least("i", "j") >= F.col("a"))
    )
    pairs = pairs.dropDuplicates([*key, "notice"])
    shared = F.size(F.array_intersect("held", "ranks"))
    return pairs.where(shared >= F.col("a")).select("k0", "k1", "k2", "notice", "label", (shared / F.col("m")).alias("containment"))


def _in_windows(docs: DataFrame, order: DataFrame, ranked: DataFrame, prefix: DataFrame, sent) -> DataFrame:
    """Windows of words against notices. Texts with a token of a notice's prefix are its candidates, those with too few of its tokens go; of
    the others each place of a token begins a window."""
    key = ["k0", "k1", "k2"]
    widest = SPREAD * (ranked.agg(F.max("m")).first()[0] or 1)
    places = docs.select(*key, F.posexplode(_words(F.col("low"))).alias("pos", "token")).join(sent(order), "token").select(*key, "pos", "rank")
    tokens = ranked.select("notice", "label", "m", "a", F.explode("ranks").alias("rank"))
    rare = prefix.select("notice", "rank", F.lit(True).alias("rare"))
    own = places.join(sent(tokens.join(rare, ["notice", "rank"], "left")), "rank")
    enough = own.groupBy(*key, "notice").agg(F.max("rare").alias("rare"), F.count_distinct("rank").alias("n"), F.first("a").alias("a")).where("rare and n >= a")
    own = own.join(enough.select(*key, "notice"), [*key, "notice"])
    near = F.collect_list(F.struct("pos", "rank")).over(Window.partitionBy(*key, "notice").orderBy("pos").rangeBetween(0, widest - 1))
    inside = F.filter("near", lambda x: x["pos"] < F.col("pos") + SPREAD * F.col("m"))
    held = own.withColumn("near", near).withColumn("shared", F.size(F.array_distinct(F.transform(inside, lambda x: x["rank"]))))
    return held.where("shared >= a").select(*key, "notice", "label", (F.col("shared") / F.col("m")).alias("containment"))


def scan(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES, threshold: float = 0.8) -> DataFrame:
    """docs(doc_id, text, ...) -> one row for each input row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    A-Z are lower-cased; words are runs of ASCII letters and digits and of non-ASCII characters. n_base
    counts the places where a phrase's words stand consecutively, first_word and last_word are the
    smallest and largest start (words from 0; null without one). Blocks are lines and windows of
    words; labels are the phrases' and those of notices contained to `threshold`, distinct, sorted, comma-joined
    ("" for none). score is 1 with a phrase, else the largest containment found that meets the threshold, else 0.
    Null texts count as empty, null ids keep their rows, repeated rows each get theirs, other columns are ignored.
    """
    spark = docs.sparkSession
    rows = stored(first_pass(docs, phrases, notices, threshold), "license-words")
    counts = rows.select(F.explode("present").alias("token")).groupBy("token").count()
    again = stored(rows.where("may").select("k0", "k1", "k2").distinct(), "license-texts")
    few = again.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    texts = docs.select(*row_key(), ascii_lower(F.col("text").cast("string")).alias("low"))
    texts = texts.join(F.broadcast(again) if few else again, ["k0", "k1", "k2"]).dropDuplicates(["k0", "k1", "k2"])
    found = contained(texts, notices_frame(spark, notices), counts, threshold)
    found = found.groupBy("k0", "k1", "k2").agg(F.max("containment").alias("best"), F.collect_set("label").alias("extra"))
    every = F.flatten("places")
    labels = F.filter(F.transform(F.arrays_zip("places", F.array(*(F.lit(x) for _, x in phrases)).alias("label")), lambda z: F.when(F.size(z["places"]) > 0, z["label"])), lambda x: x.isNotNull())
    base = phrase_places(texts, phrases).select(
        "k0", "k1", "k2", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"), labels.alias("base"),
    )
    facts = stored(base.join(found, ["k0", "k1", "k2"], "left").where("n_base > 0 or best is not null"), "license-facts")
    discard(again)
    out = rows.join(facts, ["k0", "k1", "k2"], "left")
    none = F.array().cast("array<string>")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word", joined(F.coalesce("base", none)).alias("base_labels"),
        joined(F.concat(F.coalesce("base", none), F.coalesce("extra", none))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql(phrases: tuple = PHRASES, notices: tuple = NOTICES, threshold: float = 0.8) -> str:
    """The same result in DuckDB's SQL, by comparing every block that has a notice's tokens with every notice."""
    values = ", ".join(f"({i}, {_literal(a)}, {_literal(w)})" for i, (a, t) in enumerate(notices) for w in notice_words(t))
    gap, word = GAP.replace("\\", "\\"), WORD
    wheres = []
    for p, label in phrases:
        parts = p.split()
        hit = " AND ".join(f"ws[i + {k}] = {_literal(w)}" for k, w in enumerate(parts, 1))
        wheres.append(f"SELECT rid, i, {_literal(label)} AS label FROM places WHERE {hit}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS low FROM documents),
w AS (SELECT rid, doc_id, low, regexp_extract_all(low, '{word}') AS ws FROM d),
places AS (SELECT rid, ws, unnest(range(len(ws))) AS i FROM w WHERE low LIKE '%license%' OR low LIKE '%cc%'),
hits AS ({" UNION ALL ".join(wheres)}),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM hits GROUP BY rid),
notices(notice, label, token) AS (VALUES {values}),
sizes AS (SELECT notice, any_value(label) AS label, count(*) AS m FROM notices GROUP BY notice),
lines AS (SELECT rid, line, list_distinct(regexp_extract_all(t, '{word}')) AS ws FROM (SELECT rid, unnest(string_split(low, chr(10))) AS t, generate_subscripts(string_split(low, chr(10)), 1) AS line FROM d)),
tokens AS (SELECT rid, line, unnest(ws) AS token FROM lines),
shared AS (SELECT rid, line, notice, count(*) AS n FROM tokens JOIN notices USING (token) GROUP BY ALL),
words AS (SELECT rid, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM w),
own AS (SELECT rid, pos, token, notice, m FROM words JOIN notices USING (token) JOIN sizes USING (notice)),
windows AS (SELECT rid, notice, count(DISTINCT token) OVER (PARTITION BY rid, notice ORDER BY pos RANGE BETWEEN CURRENT ROW AND ({SPREAD} * m - 1) FOLLOWING) AS n FROM own),
found AS (SELECT rid, notice, n FROM shared UNION ALL SELECT rid, notice, n FROM windows),
kept AS (SELECT rid, label, n::DOUBLE / m AS c FROM found JOIN sizes USING (notice) WHERE n >= ceil(m * {threshold} - 1e-9)),
extra AS (SELECT rid, max(c) AS best, list(DISTINCT label) AS extra FROM kept GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
 coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []::VARCHAR[]), coalesce(extra, []::VARCHAR[])))), ','), '') AS labels,
 CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN extra USING (rid)"""
