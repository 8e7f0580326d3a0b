import random

import pytest
from pyspark.sql import functions as F

from sparkwright.functions import text as T
from sparkwright.functions import words as W


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_tokens_of_any_script(spark):
    assert one(spark, "Électricité où", T.tokens) == ["électricité", "où"]
    assert one(spark, "Hello World! This is a test.", T.tokens) == "hello world this is a test".split()


def test_words_of_a_batch_are_the_tokens(spark, monkeypatch):
    monkeypatch.setattr(W, "BATCH_BYTES", 500)
    rng = random.Random(3)
    odd = [chr(c) for a, b in ((0, 0x250), (0x300, 0x380), (0x900, 0x980), (0x2000, 0x2070), (0x10400, 0x10430), (0x1F600, 0x1F610)) for c in range(a, b)]
    texts = ["".join(rng.choices(odd + [" "] * 200 + list("abc") * 60, k=rng.randrange(80))) for _ in range(2000)]
    texts += ["", "a", "a", "é", "_", "", "\u0130stanbul \u0391\u03a3", "\u200d\u2160\u00bd", "\U0010ffff\uffff\ufeff", "x" * 2000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.lower("t").alias("t"), T.tokens(F.col("t")).alias("tokens"))
    got = df.toArrow().combine_chunks().sort_by("i")
    column, points, found = got["t"].combine_chunks(), W.word_points(W.word_ranges(spark)), []
    parts = list(W.pieces(column))
    assert len(parts) > 50 and sum(p.stop - p.start for p in parts) == len(texts)
    for part in parts:
        words, rows = W.words(column[part], points)
        own = [[] for _ in range(part.stop - part.start)]
        for w, i in zip(words.to_pylist(), rows):
            own[i].append(w)
        found += own
    assert found == got["tokens"].to_pylist()
    assert list(W.pieces(column[:0])) == [] and len(W.words(column[:0], points)[0]) == 0


@pytest.mark.parametrize("text,loc,ratio", [("x = 1\n\n# c\n// d\ny", 2, 0.4), ("", 0, 0.0), ("a\n", 1, 0.0), ("#\x0cb", 1, 0.5)])
def test_lines(spark, text, loc, ratio):
    assert one(spark, text, T.loc) == loc
    assert one(spark, text, T.comment_ratio) == ratio


def test_references_leave_stop_names_out(spark):
    assert one(spark, "def foo():\n  bar()\n  str(len(x))\n  return MyClass()", T.references) == ["MyClass", "bar", "foo"]


# Words and stems published with the algorithm.
STEMS = {"caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
         "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky",
         "relational": "relat", "conditional": "condit", "triplicate": "triplic", "formative": "form", "electricity": "electr", "hopeful": "hope", "goodness": "good",
         "revival": "reviv", "adjustable": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}


@pytest.mark.parametrize("word", STEMS)
def test_stem(word):
    assert T.porter_stem(word) == STEMS[word]
