"""Text columns: tokens, line counts, references, digests, token estimates and Porter stems."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: What Python's splitlines() splits on.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"
WORD = r"(?U)\w+"

# Names that count as no reference, and the three forms of a reference.
STOP_NAMES = ("if", "for", "while", "with", "def", "class", "return", "print", "str", "int", "list", "dict", "set", "len", "range")
CALL = r"(?U)\b([a-zA-Z_]\w*)\s*\("
BASES = r"(?U)class\s+\w+\s*\(\s*([^)]+)\)"
IMPORTED = r"(?U)from\s+\S+\s+import\s+([^#\n]+)"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, of any script; null text gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without their ends; the empty piece after a last line end is no line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _is_comment(line: Column) -> Column:
    bare = strip(line)
    return bare.startswith("#") | bare.startswith("//")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def loc(text: Column) -> Column:
    """Lines that are neither blank nor comments."""
    return F.size(F.filter(lines(text), lambda x: (strip(x) != "") & ~_is_comment(x)))


def comment_ratio(text: Column) -> Column:
    """Comment lines by all lines; 0 without lines."""
    every = lines(text)
    return F.when(F.size(every) == 0, F.lit(0.0)).otherwise(F.size(F.filter(every, _is_comment)) / F.size(every))


def references(code: Column) -> Column:
    """Sorted distinct names that code calls, inherits from or imports."""
    calls = F.array_except(F.regexp_extract_all(code, F.lit(CALL), F.lit(1)), F.array(*map(F.lit, STOP_NAMES)))
    pieces = lambda pattern: F.flatten(F.transform(F.regexp_extract_all(code, F.lit(pattern), F.lit(1)), lambda x: F.split(x, ",")))
    bases = F.transform(pieces(BASES), lambda x: F.element_at(F.split(strip(x), r"\."), 1))
    names = F.transform(pieces(IMPORTED), lambda x: strip(F.element_at(F.split(strip(x), " as "), 1)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(calls, bases, names), lambda x: x != "")))


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(content: Column, kind: Column, prompt: Column) -> Column:
    return F.md5(F.concat_ws(":", content, kind, F.coalesce(prompt, F.lit(""))))


def strip_name(content: Column, name: Column) -> Column:
    """content without the first occurrence of the name and a space, wherever it stands."""
    at = F.instr(content, F.concat(name, F.lit(" ")))
    return F.when(at > 0, F.concat(F.substring(content, F.lit(1), at - 1), F.substring(content, at + F.length(name) + 1, F.length(content)))).otherwise(content)


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def last_but_one(identifier: Column) -> Column:
    """The name in an id of the form file:name:line; the whole id where it has no such part."""
    parts = F.split(identifier, ":")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(identifier)


def porter_stem(word: str) -> str:
    """Porter's algorithm of 1980, for words of a to z; others are returned as they are."""
    if len(word) < 3 or not re.fullmatch(r"[a-z]+", word):
        return word

    def shape(s: str) -> str:
        out = ""
        for i, c in enumerate(s):
            vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
            out += "v" if vowel else "c"
        return out

    measure = lambda s: len(re.findall("v+c+", shape(s)))
    has_vowel = lambda s: "v" in shape(s)
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and shape(s)[-1] == "c"
    short = lambda s: len(s) > 2 and shape(s)[-3:] == "cvc" and s[-1] not in "wxy"

    def swap(s: str, rules: dict[str, str], least: int) -> str:
        for end in sorted(rules, key=len, reverse=True):
            if s.endswith(end):
                stem = s[: -len(end)]
                if end == "ion" and not stem.endswith(("s", "t")):
                    return s
                return stem + rules[end] if measure(stem) > least else s
        return s

    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, SECOND, 0)
    w = swap(w, THIRD, 0)
    w = swap(w, FOURTH, 1)
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if double(w) and w.endswith("l") and measure(w) > 1 else w


# The suffixes of the steps of Porter's algorithm.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")


@F.pandas_udf(ArrayType(StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """The stem of each token; a token is stemmed once for each batch."""
    known: dict[str, str] = {}

    def one(w: str) -> str:
        if w not in known:
            known[w] = porter_stem(w)
        return known[w]

    return tokens.map(lambda ws: None if ws is None else [one(w) for w in ws])
