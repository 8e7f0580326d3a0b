"""Small awkward tables, and plain forms of what the operators do."""

import zlib

from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, component_id string, h string, rank int"
LONG = " ".join(f"word{i % 997} the of" for i in range(8000))
PLAIN = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the woods"


def documents():
    """Nulls, empty and very long texts, ties, repeated rows; further columns with names that operators use."""
    texts = [None, "", "   \n\t ", LONG, PLAIN, PLAIN, PLAIN.replace("lazy", "sleepy"), "idiot", "Ünïcode ÀÉ ça où", "a", "A", "MIT License here", "x" * 5000, "\x1cfoo\x85bar don't <|endoftext|> 12ab3"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 1.0, "c", "h", 1) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, PLAIN, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (3, "other text with id three", "en", "s0", 5, 1.0, "c", "h", 1)]
    return rows


def awkward(spark):
    return spark.createDataFrame(documents(), DOCS).withColumn("text.x`y", F.lit("dotted"))


def empty(spark):
    return spark.createDataFrame([], DOCS).withColumn("text.x`y", F.lit("dotted"))


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2
