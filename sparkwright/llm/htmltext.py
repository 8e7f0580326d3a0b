"""Main text of web pages: markup, and a suffix array over each host's pages.

A page falls into blocks, each in a region: the elements around it, by tag and class. The words of a
host's pages are concatenated, page by page, and a suffix array finds the long runs that stand on
two pages or more. What such runs cover is boilerplate where it stands in a region that repeats: of a
region's words on the host nine in ten lie in runs, over the pages whose articles have words of their
own. Single repeats say less: copies of an article and passages that articles share repeat as well,
in regions that mostly don't. Those stay.

The text of a page is what the markup calls its article, without the elements that it names as menus,
adverts and the like (an advert may stand on one page only) and without the regions that repeat. Where
a page marks no article, each block is judged by its own words: those that runs cover are boilerplate,
those with runs of their own are the text.

A large host's pages are dealt into groups with a suffix array each; a region's words are summed over
the groups. What repeats doesn't depend on the groups: they compare their windows of MIN_RUN words over the
whole host, by shuffles in two steps. First a window is a cell, a number of few bits that equal windows share,
and each group is told which of its cells others have too. That bounds each region's repeats from above, and
few hosts have a region that may repeat then. Only their groups go on: they compare the hashes of windows in
such cells, which tells exactly what repeats.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import bounded_batches, stored
from sparkwright.llm.decontaminate import gram_hashes

MIN_RUN = 4
PACKED = ("keys", "counts", "size", "data")
#: A group holds about so many pages, and so many characters of html.
PAGES, GROUP_CHARS = 256, 4 << 20
#: Windows of a host's groups meet in ranges of their hashes or cells; a range holds about as many as so many groups.
RANGE_GROUPS = 16
#: Characters of a host's html for each of its cells: a cell holds few of its windows. More cells tell more and take more room.
CELL_CHARS = 2
#: Characters of text that a task gathers before it sends them: a group's pages are compressed together.
GATHER_CHARS = 1 << 25
#: A region repeats if so large a share of its words lies in runs.
REPEATS = 0.9
#: It is judged by this many pages or more, each with this share of its article's words in no run: copies of an article tell nothing.
JUDGES, OWN_SHARE = 3, 0.25
#: More regions than this to leave out and they meet the pages by shuffle.
BROADCAST_REGIONS = 100_000
#: More large hosts than this and their table is joined by shuffle.
BROADCAST_HOSTS = 50_000

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|select|title"
JUNK = frozenset("nav footer header aside form menu dialog button head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var".split()
)
JUNK_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form header masthead menu "
    "nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget".split()
)
# Words that beside one of those leave a class what it is; beside any other it names something else (share-price, form-factor).
LAYOUT = frozenset(
    "area article articles bar block body bottom box button buttons col column container content foot global group head icon icons inline inner item items left link "
    "links list main media module outer page panel post posts right row section site slot sticky stories text top unit wrap wrapper".split()
)
ARTICLE = frozenset(("article", "main"))

TOKEN = re.compile(
    rf"""<!--(?:.*?--!?>|.*\Z)|<({RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*[^>]*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'](?=[^"'>]*>))*)>|<[!?/][^>]*(?:>|\Z)""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"[0-9]+")


JUNK_BLOCK, OPEN_BLOCK, ARTICLE_BLOCK = 0, 1, 2


@dataclass
class Parsed:
    """Blocks in order, what the markup says of each, and each one's region as a number."""

    blocks: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    regions: list[int] = field(default_factory=list)
    has_article: bool = False

    @property
    def article(self) -> list[str]:
        return [b for b, k in zip(self.blocks, self.kinds) if k == ARTICLE_BLOCK]

    @property
    def outside(self) -> list[str]:
        return [b for b, k in zip(self.blocks, self.kinds) if k != ARTICLE_BLOCK]

    @property
    def open(self) -> list[bool]:
        return [k == OPEN_BLOCK for k in self.kinds if k != ARTICLE_BLOCK]


def _junk_name(value: str) -> bool:
    """Whether one of a class or id attribute's names calls its element boilerplate."""
    for name in value.split():
        parts = [x for x in PART.split(name) if x]
        if not JUNK_NAMES.isdisjoint(parts) and all(x in JUNK_NAMES or x in LAYOUT or len(x) == 1 or x.isdigit() for x in parts):
            return True
    return False


def _nature(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element is boilerplate, whether it is an article, and its name for regions. inside: of an article, whose header is its own."""
    junk, article, region = tag in JUNK and not (inside and tag == "header"), tag in ARTICLE, tag
    if attributes and not attributes.isspace():
        for name, a, b, c in NAMED.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                junk = True
            elif name == "role":
                junk |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert")
                article |= value in ("main", "article")
            elif name == "itemprop":
                article |= value == "articlebody"
            elif name in ("class", "id"):
                junk |= _junk_name(value) and tag not in ("html", "body")
                if name == "class":
                    region += "." + ".".join(sorted(DIGITS.sub("0", value).split()))
    return junk, article, region


def parse(page: str | None) -> Parsed:
    """Blocks of a page in order, white space made one space, character references decoded, empty ones left out."""
    out, stack, runs = Parsed(), [], []
    junk = article = 0

    def flush() -> None:
        if runs:
            text = " ".join("".join(runs).split())
            runs.clear()
            if text:
                path = "/".join(x[3] for x in stack if x[3])
                out.blocks.append(text)
                out.kinds.append(JUNK_BLOCK if junk else ARTICLE_BLOCK if article else OPEN_BLOCK)
                out.regions.append(zlib.crc32(path.encode("utf-8", "replace")))

    def pop(to: int) -> None:
        nonlocal junk, article
        for _, j, a, _ in stack[to:]:
            junk -= j
            article -= a
        del stack[to:]

    page, at = page or "", 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            runs.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                runs.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            flush()
        if m[2]:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != tag and not (tag in INLINE and stack[k][0] not in INLINE):
                k -= 1
            if k >= 0 and stack[k][0] == tag:
                if any(j or a for _, j, a, _ in stack[k:]):
                    flush()
                pop(k)
            continue
        if tag not in INLINE:
            k = len(stack)
            while k and (stack[k - 1][0] in INLINE or stack[k - 1][0] == "p" or (stack[k - 1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"))):
                k -= 1
                if stack[k][0] == "p" or stack[k][0] == tag:
                    pop(k)
                    break
        j, a, region = _nature(tag, m[4], article > 0)
        if j or a:
            flush()
        if not m[4].rstrip().endswith("/") or tag not in INLINE:
            stack.append((tag, j, a, "" if tag in INLINE else region))
            junk += j
            article += a
            out.has_article |= a and not junk
    if at < len(page):
        runs.append(html.unescape(page[at:]))
    flush()
    return out


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of numbers: the suffixes in order, and for each power of two the ranks by that many first tokens.

    With a depth, suffixes that agree in so many first tokens need not be told apart.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int32)
    levels, width, n = [rank], 1, len(tokens)
    while n and rank.max() < n - 1 and (depth is None or width < depth):
        follow = np.full(n, -1, np.int32)
        follow[: max(0, n - width)] = rank[width:]
        order = np.lexsort((follow, rank))
        a, b = rank[order], follow[order]
        fresh = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = np.empty(n, np.int32)
        rank[order] = fresh
        levels.append(rank)
        width *= 2
    return np.argsort(rank, kind="stable"), levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many first tokens each suffix in order shares with the one before it: from the ranks, the widest first."""
    n = len(order)
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank, width = levels[k], 1 << k
        fits = (a + width <= n) & (b + width <= n)
        same = fits & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        a[same] += width
        b[same] += width
        out[same] += width
    return np.concatenate([[0], out]) if n else out


class WordHashes(dict):
    """A hash of each word, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
        return found


def window_hashes(words: list[str], min_run: int, known: WordHashes) -> np.ndarray:
    """A hash of each min_run consecutive words."""
    return gram_hashes(np.array([known[w] for w in words], np.int64), min_run).view(np.int64)


def mark_windows(pages: list[list[str]], covered: list[np.ndarray], shared: np.ndarray, min_run: int) -> None:
    """Adds to `covered` the words in windows whose hash is among `shared`."""
    known = WordHashes()
    for words, own in zip(pages, covered):
        (at,) = np.nonzero(np.isin(window_hashes(words, min_run, known), shared))
        for k in range(min_run):
            own[at + k] = True


def repeated(pages: list[list[str]], min_run: int = MIN_RUN) -> list[np.ndarray]:
    """Of each page's words, which stand in a run of min_run words or more that another page has too."""
    numbers: dict[str, int] = {}
    return covered_words([np.array([numbers.setdefault(w, len(numbers)) for w in p], np.int64) for p in pages], min_run)


def covered_words(pages: list[np.ndarray], min_run: int = MIN_RUN) -> list[np.ndarray]:
    """As repeated(), of words as numbers from 0."""
    sizes = np.array([len(p) for p in pages], np.int64)
    if not sizes.sum() or len(pages) < 2:
        return [np.zeros(n, bool) for n in sizes]
    # after each page a separator of its own, so that no run crosses pages
    ends = np.cumsum(sizes + 1) - 1
    tokens, owner = np.empty(int(ends[-1]) + 1, np.int64), np.repeat(np.arange(len(pages)), sizes + 1)
    tokens[ends] = -1 - np.arange(len(pages))
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = np.concatenate(pages)
    order, levels = suffix_array(tokens, min_run)  # longer runs are covered by the shortest ones
    lcp = common_prefixes(order, levels)
    starts = np.nonzero(lcp < min_run)[0]
    page = owner[order]
    shared = np.minimum.reduceat(page, starts) != np.maximum.reduceat(page, starts)
    at = order[np.repeat(shared, np.diff(np.append(starts, len(order))))]
    marks = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, np.minimum(at + min_run, len(tokens)), -1)
    covered = np.cumsum(marks)[:-1] > 0
    return [covered[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]


def packed_pages(pages: list[tuple[int, list[str], list[int]]]) -> tuple[list[int], list[int], int, bytes]:
    """Pages as (key, blocks, mark of each block) -> keys, numbers of blocks, and the marks and blocks compressed together, with their size."""
    marks = np.array([m for _, _, each in pages for m in each], "<i8").tobytes()
    raw = marks + "\n".join(x for _, blocks, _ in pages for x in blocks).encode("utf-8", "replace")
    return [k for k, _, _ in pages], [len(x) for _, x, _ in pages], len(raw), pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def unpacked_pages(keys: list[int], counts: list[int], size: int, data: bytes) -> Iterator[tuple[int, list[str], np.ndarray]]:
    raw, total, at = pa.Codec("zstd").decompress(data, size, asbytes=True), sum(counts), 0
    marks, blocks = np.frombuffer(raw, "<i8", total), raw[8 * total :].decode().split("\n")
    for key, n in zip(keys, counts):
        yield key, blocks[at : at + n], marks[at : at + n]
        at += n


def numbered_pages(rows: Iterable[tuple], numbers: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a group as packed_pages() gives them -> distinct pages as region_words() takes them; `numbers` gets the words."""
    held: dict[int, tuple] = {}
    for row in rows:
        for page, blocks, marks in unpacked_pages(*row):
            if page not in held:
                words = [x.split() for x in blocks]
                stream = np.array([numbers.setdefault(w, len(numbers)) for x in words for w in x], np.int64)
                held[page] = (stream, np.array([len(x) for x in words], np.int64), marks & 3, marks >> 2)
    return list(held.values())


def word_hashes(words: list[str]) -> np.ndarray:
    """As WordHashes, of many words at once, by another hash."""
    return pd.util.hash_array(np.array(words, object)) if words else np.zeros(0, np.uint64)


def short_hashes(words: np.ndarray, min_run: int) -> np.ndarray:
    """Of words' hashes those of their windows, of 48 bits each."""
    return (gram_hashes(words, min_run) >> np.uint64(16)).astype(np.int64)


def window_cells(words: np.ndarray, min_run: int, cells: int) -> np.ndarray:
    """Of words' hashes the cell of each window, a number below `cells`. Equal windows have equal cells.

    A window's cell is that of the lesser one of its two windows of a word less, so neighbours often share it
    and a page has about two for three windows.
    """
    if min_run > 2:
        less = short_hashes(words, min_run - 1)
        found = np.minimum(less[:-1], less[1:])
    else:
        found = short_hashes(words, min_run)
    return np.minimum(found * (cells / (1 << 48)), cells - 1).astype(np.int64)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """Those from 0, in order; numpy's unique() is slower."""
    numbers = np.sort(numbers)
    return numbers[np.diff(numbers, prepend=-1) > 0]


def among(numbers: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Whether each number is among those in ascending order."""
    if not len(ascending):
        return np.zeros(len(numbers), bool)
    return ascending[np.minimum(np.searchsorted(ascending, numbers), len(ascending) - 1)] == numbers


def pack(ascending: np.ndarray) -> bytes:
    """Numbers in ascending order by their differences, all lowest bytes first: the high ones are mostly zeros, the others told by their frequency."""
    coder = zlib.compressobj(1, zlib.DEFLATED, 15, 9, zlib.Z_RLE)
    return coder.compress(np.diff(ascending, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()) + coder.flush()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel())


def cover(runs_of: list[np.ndarray], windows: list[np.ndarray], shared: np.ndarray, min_run: int) -> None:
    """Marks the words of pages' windows whose number is among `shared`, which are in ascending order."""
    hits = among(np.concatenate(windows), shared)
    for (at,), covered in zip(map(np.nonzero, np.split(hits, np.cumsum([len(x) for x in windows])[:-1])), runs_of):
        for k in range(min_run):
            covered[at + k] = True


def region_bounds(
    pages: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], min_run: int, windows: list[np.ndarray], shared: np.ndarray
) -> dict[int, tuple[int, float]]:
    """As region_words(), where `shared` may have windows that no other group has: by region the pages that may judge
    it, and at most by how many its words in runs exceed those that a region that repeats has."""
    out: dict[int, tuple[int, float]] = {}
    least = covered_words([p[0] for p in pages], min_run)
    most = [x.copy() for x in least]
    cover(most, windows, shared, min_run)
    for (_, lengths, kinds, regions), low, high in zip(pages, least, most):
        mine = np.repeat(kinds == ARTICLE_BLOCK, lengths)
        if not mine.any() or 1 - low[mine].mean() < OWN_SHARE:
            continue
        sure = 1 - high[mine].mean() >= OWN_SHARE
        names, which = np.unique(regions, return_inverse=True)
        of = np.repeat(which, lengths)
        words, runs = np.bincount(of[mine], minlength=len(names)), np.bincount(of[mine & high], minlength=len(names))
        for r, n, c in zip(names.tolist(), words.tolist(), runs.tolist()):
            if n:
                was, over = out.get(r, (0, 0.0)), c - REPEATS * n
                out[r] = (was[0] + 1, was[1] + (over if sure else max(0.0, over)))
    return out


def region_words(
    pages: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], min_run: int = MIN_RUN, windows: list[np.ndarray] | None = None, shared: np.ndarray | None = None
) -> dict[int, tuple[int, int, int]]:
    """Pages of a group as (words as numbers; of each block the words, the kind and the region) -> by region with an
    article's blocks their words, those in repeated runs and the pages, of pages whose articles have their own share.

    `shared` has the hashes among the pages' `windows` that stand in other groups of the host, in ascending order.
    """
    out: dict[int, tuple[int, int, int]] = {}
    runs_of = covered_words([p[0] for p in pages], min_run)
    if shared is not None:
        cover(runs_of, windows, shared, min_run)
    for (_, lengths, kinds, regions), covered in zip(pages, runs_of):
        mine = np.repeat(kinds == ARTICLE_BLOCK, lengths)
        if not mine.any() or 1 - covered[mine].mean() < OWN_SHARE:
            continue
        names, which = np.unique(regions, return_inverse=True)
        of = np.repeat(which, lengths)
        words, runs = np.bincount(of[mine], minlength=len(names)), np.bincount(of[mine & covered], minlength=len(names))
        for r, n, c in zip(names.tolist(), words.tolist(), runs.tolist()):
            if n:
                was = out.get(r, (0, 0, 0))
                out[r] = (was[0] + n, was[1] + c, was[2] + 1)
    return out


def decide(rows: list[dict], min_run: int = MIN_RUN, shared: np.ndarray | None = None) -> list[list[str]]:
    """Of pages of one host that mark no article: the blocks of each one's text.

    `shared` has the hashes of windows that stand on two pages of the host, if these rows aren't all of it.
    """
    words = [[w for b in r["blocks"] for w in b.split()] for r in rows]
    found = repeated(words, min_run)
    if shared is not None:
        mark_windows(words, found, shared, min_run)
    out = []
    for r, covered in zip(rows, found):
        sizes = [len(b.split()) for b in r["blocks"]]
        ends = np.cumsum(sizes).tolist()
        spans = [(b, covered[e - n : e].mean()) for b, e, n, kind in zip(r["blocks"], ends, sizes, r["kinds"]) if kind != JUNK_BLOCK]
        own = [b for b, share in spans if share < 0.5]
        out.append(own or [b for b, _ in spans])  # nothing of its own: a copy of a page, not boilerplate
    return out


def extract(pages: DataFrame, min_run: int = MIN_RUN, per_group: int = PAGES) -> DataFrame:
    """pages(page_id, url, html, ...) -> one row for each input row: page_id, url, text, n_chars, left_out.

    Null and empty html give an empty text; a null or odd url belongs to the host ""; null ids and repeated
    rows keep their rows; further columns are ignored. left_out counts the article's blocks in regions that
    repeat on the host. A host of many pages is searched in groups of about per_group pages, fewer if they are
    long, so no task holds more than a group; equal pages of a host are one page there. Pages are parsed once;
    what moves to the groups is compressed, and the text of a page with an article stays where it was parsed.
    """
    bounded_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = own.withColumn("host", host)
    groups = F.greatest(F.ceil(F.count("*") / per_group), F.ceil(F.coalesce(F.sum(F.length("html")), F.lit(0)) / GROUP_CHARS))
    cells = F.greatest(F.lit(1), F.sum(F.length("html")) / CELL_CHARS).cast("bigint")
    large = stored(own.groupBy("host").agg(groups.alias("groups"), cells.alias("cells")).where("groups > 1"), "large-hosts")
    few = large.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    own = own.join(F.broadcast(large) if few else large, "host", "left")
    key = F.xxhash64(F.coalesce("html", F.lit("")))
    group = F.pmod(F.xxhash64(key), F.coalesce("groups", F.lit(1)))  # equal pages meet, as they are one
    own = own.select("host", group.alias("grp"), "page_id", "url", "groups", "cells", key.alias("key"), "html")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(t.as_py()) for t in b.column(7)]
            cols = [pa.array([p.has_article for p in found], pa.bool_()), pa.array([p.blocks for p in found], pa.list_(pa.string()))]
            cols += [pa.array([p.kinds for p in found], pa.list_(pa.int32())), pa.array([p.regions for p in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], *cols], ["host", "grp", "page_id", "url", "groups", "cells", "key", "has_article", "blocks", "kinds", "regions"])

    schema = "host string, grp bigint, page_id bigint, url string, groups bigint, cells bigint, key bigint, has_article boolean, blocks array<string>, kinds array<int>, regions array<bigint>"
    parsed = stored(own.mapInArrow(cut, schema), "pages", compression="zstd", **{"parquet.compression.codec.zstd.level": "6"})
    drops = _repeating_regions(parsed.where("has_article"), min_run)
    marked = parsed.where("has_article").join(drops, "host", "left")
    mine = F.filter(F.arrays_zip("blocks", "kinds", "regions"), lambda x: x["kinds"] == ARTICLE_BLOCK)
    kept = F.filter(mine, lambda x: ~F.coalesce(F.array_contains("drops", x["regions"]), F.lit(False)))
    marked = marked.withColumn("mine", mine).withColumn("kept", F.when(F.col("drops").isNull(), F.col("mine")).otherwise(kept))
    marked = marked.select("page_id", "url", F.array_join("kept.blocks", "\n").alias("text"), (F.size("mine") - F.size("kept")).cast("bigint").alias("left_out"))
    unmarked = _unmarked(parsed.where("not has_article"), min_run)
    out = marked.unionByName(unmarked)
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "left_out")


def _repeating_regions(parsed: DataFrame, min_run: int) -> DataFrame:
    """(host, drops): the regions that repeat on the host and hold blocks of articles; sent to all executors if there are few."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        held: dict[tuple, list[tuple]] = {}
        size = 0

        def sent() -> pa.RecordBatch:
            cols = list(zip(*((*at, *packed_pages(pages)) for at, pages in held.items()))) or [[]] * 8
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], ["host", "grp", "groups", "cells", "keys", "counts", "size", "data"])

        for b in batches:
            for host, grp, groups, cells, page, blocks, kinds, regions in zip(*(c.to_pylist() for c in b.columns)):
                if (host, grp, page) in seen:  # equal pages are one; a task sends each once, or seldom
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add((host, grp, page))
                held.setdefault((host, grp, groups, cells), []).append((page, blocks, [4 * r + k for r, k in zip(regions, kinds)]))
                size += sum(map(len, blocks)) + 8 * len(blocks)
                if size > GATHER_CHARS:
                    yield sent()
                    held, size = {}, 0
        if held:
            yield sent()

    def summed(host: str, found: dict[int, tuple[int, int, int]]) -> pa.RecordBatch:
        cols = [pa.array([host] * len(found), pa.string()), pa.array(list(found), pa.int64())]
        cols += [pa.array([x[i] for x in found.values()], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays(cols, ["host", "region", "words", "runs", "pages"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at: str | None = None
        for b in batches:
            for host, *row in zip(*(b.column(n).to_pylist() for n in ("host", *PACKED))):
                if host != at:
                    if held:
                        yield summed(at, region_words(numbered_pages(held, {}), min_run))
                    held, at = [], host
                held.append(row)
        if held:
            yield summed(at, region_words(numbered_pages(held, {}), min_run))

    def opened(group: pa.Table) -> tuple[list[tuple], np.ndarray]:
        """A group's distinct pages, and the hashes of its words by number."""
        numbers: dict[str, int] = {}
        pages = numbered_pages(zip(*(group.column(n).to_pylist() for n in PACKED)), numbers)
        return pages, word_hashes(list(numbers))

    def ranges(group: pa.Table, ascending: np.ndarray, upto: int) -> pa.Table:
        """A row for each range of a group's numbers, all below `upto`."""
        host, grp, groups = (group.column(n)[0].as_py() for n in ("host", "grp", "groups"))
        parts = -(-groups // RANGE_GROUPS)
        cuts = np.searchsorted(ascending, np.arange(1, parts) * -(-upto // parts))
        rows = [(host, k, grp, pack(x)) for k, x in enumerate(np.split(ascending, cuts)) if len(x)]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["host", "part", "grp", "hashes"])

    def told_of(told: pa.Table) -> np.ndarray:
        """What a group is told, in ascending order: ranges come in any order."""
        return np.sort(np.concatenate([np.zeros(0, np.int64), *(unpack(x.as_py()) for x in told.column("hashes"))]))

    def sketch(group: pa.Table) -> pa.Table:
        pages, table = opened(group)
        cells = group.column("cells")[0].as_py()
        return ranges(group, distinct(np.concatenate([window_cells(table[p[0]], min_run, cells) for p in pages])), cells)

    def meet(part: pa.Table) -> pa.Table:
        """Of a range of a host's hashes, for each group those that another group has too."""
        each = [unpack(x.as_py()) for x in part.column("hashes")]
        every = np.sort(np.concatenate(each))
        common = np.unique(every[1:][every[1:] == every[:-1]])
        rows = [(g, pack(x[np.isin(x, common, assume_unique=True)])) for g, x in zip(part.column("grp").to_pylist(), each)]
        return pa.table([part.column("host"), pa.array([g for g, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["host", "grp", "hashes"])

    def bound(group: pa.Table, told: pa.Table) -> pa.Table:
        """(host, region, pages, over): what cells tell of a group's regions."""
        found: dict[int, tuple[int, float]] = {}
        if group.num_rows:
            pages, table = opened(group)
            cells = group.column("cells")[0].as_py()
            found = region_bounds(pages, min_run, [window_cells(table[p[0]], min_run, cells) for p in pages], told_of(told))
        host = group.column("host")[0].as_py() if group.num_rows else ""
        cols = [pa.array([host] * len(found), pa.string()), pa.array(list(found), pa.int64())]
        cols += [pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.float64())]
        return pa.table(cols, ["host", "region", "pages", "over"])

    def windows(group: pa.Table, told: pa.Table) -> pa.Table:
        """The hashes of a group's windows that lie in cells that others have."""
        if not group.num_rows:
            return pa.table([pa.array([], k) for k in (pa.string(), pa.int64(), pa.int64(), pa.binary())], ["host", "part", "grp", "hashes"])
        pages, table = opened(group)
        cells, shared = group.column("cells")[0].as_py(), told_of(told)
        found = [short_hashes(x, min_run)[among(window_cells(x, min_run, cells), shared)] for x in (table[p[0]] for p in pages)]
        return ranges(group, distinct(np.concatenate(found)), 1 << 48)

    def judge_large(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.Table.from_batches([summed("", {})])
        pages, table = opened(group)
        found = [short_hashes(table[p[0]], min_run) for p in pages]
        return pa.Table.from_batches([summed(group.column("host")[0].as_py(), region_words(pages, min_run, found, told_of(told)))])

    out = "host string, region bigint, words bigint, runs bigint, pages bigint"
    of_range, to_group = "host string, part bigint, grp bigint, hashes binary", "host string, grp bigint, hashes binary"
    rows = parsed.select("host", "grp", "groups", "cells", "key", "blocks", "kinds", "regions")
    rows = rows.mapInArrow(stream, "host string, grp bigint, groups bigint, cells bigint, keys array<bigint>, counts array<int>, size bigint, data binary")
    small = rows.where("groups is null").repartition("host").sortWithinPartitions("host").mapInArrow(judge, out)
    # all readings of the groups come from one shuffle of them: no host is null, but the join below would filter that before a shuffle of its own
    large = rows.where("groups is not null and host is not null").repartition("host", "grp")
    cells = large.groupBy("host", "grp").applyInArrow(sketch, of_range).groupBy("host", "part").applyInArrow(meet, to_group)
    bounds = large.groupBy("host", "grp").cogroup(cells.groupBy("host", "grp")).applyInArrow(bound, "host string, region bigint, pages bigint, over double")
    bounds = bounds.groupBy("host", "region").agg(F.sum("pages").alias("pages"), F.sum("over").alias("over"))
    # an inner join stays above the shuffle of the groups, a semi-join would be pushed below it
    open_hosts = bounds.where((F.col("pages") >= JUDGES) & (F.col("over") >= -0.001)).select("host").distinct()
    large = large.join(F.broadcast(open_hosts), "host")
    told = large.groupBy("host", "grp").cogroup(cells.groupBy("host", "grp")).applyInArrow(windows, of_range).groupBy("host", "part").applyInArrow(meet, to_group)
    sums = small.unionByName(large.groupBy("host", "grp").cogroup(told.groupBy("host", "grp")).applyInArrow(judge_large, out))
    sums = sums.groupBy("host", "region").agg(*(F.sum(c).alias(c) for c in ("words", "runs", "pages")))
    repeat = sums.where((F.col("pages") >= JUDGES) & (F.col("runs") >= REPEATS * F.col("words")))
    drops = stored(repeat.groupBy("host").agg(F.collect_set("region").alias("drops")), "regions")
    return F.broadcast(drops) if (drops.agg(F.sum(F.size("drops"))).first()[0] or 0) <= BROADCAST_REGIONS else drops


def _unmarked(parsed: DataFrame, min_run: int) -> DataFrame:
    """(page_id, url, text, left_out) of pages that mark no article: each block by the runs of its host's such pages.

    Equal pages of a host are one page: copies under other ids or addresses make nothing a repeat, and get the text of the one.
    """
    few = parsed.groupBy("host", "key").agg(F.first("blocks").alias("blocks"), F.first("kinds").alias("kinds"), F.first("groups").alias("groups"))
    distinct = stored(few.withColumn("grp", F.pmod(F.xxhash64("key"), F.coalesce("groups", F.lit(1)))), "unmarked", compression="zstd")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            each = [np.unique(window_hashes([w for x in (t.as_py() or []) for w in x.split()], min_run, known)) for t in b.column(2)]
            of = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(np.concatenate(each) if each else [], pa.int64())], ["host", "grp", "hash"])

    # each page of a large host gives each of its windows once, so a count of two means two pages
    counted = distinct.where("groups is not null").select("host", "grp", "blocks").mapInArrow(windows, "host string, grp bigint, hash bigint").groupBy("host", "grp", "hash").agg(F.count("*").alias("n"))
    told = counted.groupBy("host", "hash").agg(F.sum("n").alias("n"), F.collect_list("grp").alias("grps")).where("n > 1")
    told = told.select("host", F.explode("grps").alias("grp"), "hash").groupBy("host", "grp").agg(F.collect_list("hash").alias("marks"))
    grouped = distinct.select("host", "grp", "key", "blocks", "kinds", F.lit(None).cast("array<bigint>").alias("marks")).unionByName(told, allowMissingColumns=True)
    grouped = grouped.repartition("host", "grp").sortWithinPartitions("host", "grp")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        marks: np.ndarray | None = None
        at: tuple | None = None

        def flush() -> pa.RecordBatch:
            found = decide(held, min_run, marks)
            cols = [pa.array([r["host"] for r in held], pa.string()), pa.array([r["key"] for r in held], pa.int64())]
            cols += [pa.array(["\n".join(t) for t in found], pa.string()), pa.array([len(r["blocks"]) - len(t) for r, t in zip(held, found)], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["host", "key", "text", "left_out"])

        for b in batches:
            for r in b.to_pylist():
                if (r["host"], r["grp"]) != at:
                    if held:
                        yield flush()
                    held, marks, at = [], None, (r["host"], r["grp"])
                if r["marks"] is not None:
                    marks = np.array(r["marks"], np.int64)
                else:
                    held.append(r)
        if held:
            yield flush()

    texts = grouped.mapInArrow(judge, "host string, key bigint, text string, left_out bigint")
    return parsed.select("host", "key", "page_id", "url").join(texts, ["host", "key"]).select("page_id", "url", "text", "left_out")
