"""Words of Arrow columns of texts, by numpy: those of text.tokens(), without a value in Spark for each."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkwright.functions.batches import BATCH_BYTES
from sparkwright.functions.text import WORD

POINTS = 0x110000


@lru_cache(maxsize=1)
def word_ranges(spark: SparkSession) -> np.ndarray:
    """Code points at which runs of what the pattern WORD takes begin and end, in turn, as the engine's own matcher has them."""
    points = spark.range(POINTS).where(~F.col("id").between(0xD800, 0xDFFF))
    taken = np.zeros(POINTS + 2, np.int8)
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    taken[points.where(char.rlike(WORD)).toArrow()["id"].to_numpy() + 1] = 1
    return np.flatnonzero(np.diff(taken)).astype(np.int32)


def word_points(ranges: np.ndarray) -> np.ndarray:
    """word_ranges() as a truth value for each code point."""
    marks = np.zeros(POINTS, np.int8)
    marks[ranges[ranges < POINTS]] = 1
    return np.bitwise_xor.accumulate(marks).astype(bool)


def pieces(texts: pa.Array) -> Iterator[slice]:
    """Runs of rows with BATCH_BYTES of text or so, a row at least."""
    texts, at = _plain(texts), 0
    ends = _offsets(texts)
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_BYTES, side="right")) - 1)
        yield slice(at, to)
        at = to


def _plain(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.large_binary())


def _offsets(texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def words(texts: pa.Array, points: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased texts without nulls -> all their words in order, and the number of each one's text."""
    n, texts = len(texts), _plain(texts)
    offsets = _offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    plain = bytes(points[:128]) + bytes(128)
    taken = np.frombuffer(bytearray(data).translate(plain), bool)
    lead = np.flatnonzero(data >= 0xC0)  # of the characters of two bytes and more
    size = 2 + (data[lead] >= 0xE0).astype(np.int8) + (data[lead] >= 0xF0)
    for k in (2, 3, 4):
        at = lead[size == k]
        point = (data[at] & (0x7F >> k)).astype(np.int32)
        for i in range(1, k):
            point = point << 6 | (data[at + i] & 0x3F)
        at = at[points[point]]
        for i in range(k):
            taken[at + i] = True
    edge = np.zeros(len(data) + 1, bool)  # where a text begins, a word ends
    edge[offsets] = True
    begins, ends = taken.copy(), taken.copy()
    begins[1:] &= ~taken[:-1] | edge[1:-1]
    ends[:-1] &= ~taken[1:] | edge[1:-1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    bounds = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(ends - begins + 1, out=bounds[1:])
    found = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data[taken])])
    return found, np.repeat(np.arange(n), np.diff(np.searchsorted(begins, offsets)))
