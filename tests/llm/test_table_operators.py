import base64
import collections
import gzip
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkwright.llm import encoding, htmltext, mixing, neighbours, repair, warc

from .helpers import LONG, PLAIN, awkward, documents, empty


# Token file


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.default_path())


ODD = ["abc'll don't <|endoftext|> x", "İstanbul ΑΣ Σ", "áb é", "½Ⅳ² 12ab3", "\x1cfoo\x85bar", "😀 a😀b", "!!!", "''s", " a  b\t", "ªº µ ŉ ǅ ß", "á e", "x--y... (z)", "日本語 テスト"]


@pytest.mark.parametrize("end", [None, 1])
def test_ids_are_the_librarys(library, end):
    texts = [*ODD, "", None, LONG, *(r[1] for r in documents())]
    ids, sizes = encoding.WordEncoder(encoding.default_path(), end).encode(texts)
    want = [e.ids + ([end] if end is not None else []) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == list(map(len, want))


def test_grammar_round_trip_and_slices():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 49408, rng.integers(1, 6)) for _ in range(80)]
    sizes, parts = [], []
    for n in [1, 2, *rng.integers(1, 400, 60)]:
        own = np.concatenate([words[int(i)] for i in rng.zipf(1.5, int(n)) % 80])
        parts.append(own)
        sizes.append(len(own))
    ids, sizes = np.concatenate(parts), np.array(sizes)
    alphabet, rules, symbols, per_doc = repair.compress(ids, sizes)
    block = repair.Block(alphabet, rules.astype(np.int64), repair.rule_lengths(rules, len(alphabet)), symbols, per_doc)
    assert (block.decode() == ids).all() and len(rules) > 10 and len(symbols) < 0.7 * len(ids) and per_doc.sum() == len(symbols)
    starts = np.cumsum(sizes) - sizes
    for d in range(len(sizes)):
        a, b = sorted(rng.integers(0, sizes[d] + 1, 2).tolist())
        assert (block.slice(d, a, b) == ids[starts[d] + a : starts[d] + b]).all()
    for one in (np.array([5]), np.array([5] * 1000)):
        alphabet, rules, symbols, per_doc = repair.compress(one, np.array([len(one)]))
        assert (repair.Block(alphabet, rules.astype(np.int64), repair.rule_lengths(rules, len(alphabet)), symbols, per_doc).decode() == one).all()


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.zipf(1.3, 60_000) % 3000, np.tile([7, 8, 9], 400), np.tile([1], 999)])
    sizes = np.array([100, 20_000, len(ids) - 20_100])
    _, rules, symbols, per_doc = repair.compress(ids, sizes)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(per_doc) - 1] = True
    pairs = [(a, b) for a, b, end in zip(symbols.tolist(), symbols[1:].tolist(), last.tolist()) if not end]
    assert len(rules) and max(collections.Counter(pairs).values()) < repair.MIN_COUNT


def test_grammar_of_many_ids():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.permutation(90_000), np.tile([5, 6, 70_007], 500), rng.permutation(90_000)])
    row = repair._block_row(0, 0, 0, [1, 2], ids, np.array([1000, len(ids) - 1000]))
    block = repair.read_block(row)
    assert row["width"] == 4 and (block.decode() == ids).all() and (block.slice(1, 88_000, 91_000) == ids[89_000:92_000]).all()


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_token_file(spark, library, block):
    h = lambda t: 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), 42) >> 63)
    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0, h(r[1]), r[1] or ""))
    got = [tuple(r) for r in repair.token_file(awkward(spark), block_ids=block).orderBy("start").collect()]
    want, start = [], 0
    for r in rows:
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert repair.token_file(empty(spark)).count() == 0


# Mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    out = mixing.targets([600, 10, 0, 20], [1, 2, 3, 1])
    assert out[1:] == [30.0, 0.0, 60.0] and sum(out) == pytest.approx(630)
    assert mixing.targets([], []) == []


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 500):
        p, sizes, draws = rng.random(n), rng.integers(1, 900, n).astype(float), rng.random(n)
        out = mixing.flight(p, sizes, draws)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(p.sum()) and (out * sizes).sum() == pytest.approx((p * sizes).sum())
        assert set(mixing.land(p, sizes, draws)) <= {0.0, 1.0}
    many = np.mean([mixing.flight(np.full(9, 0.3), np.arange(1.0, 10), np.random.default_rng(s).random(9)) for s in range(3000)], 0)
    assert np.allclose(many, 0.3, atol=0.03)


@pytest.mark.parametrize("block", [4096, 16])
def test_mix(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(n), f"s{int(i**0.5) % 5}", "x") for i, n in enumerate(rng.integers(1, 200, 900))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target string")
    out = mixing.mix(docs, block=block).toPandas()
    assert len(out) == 900
    totals = out.groupby("source").agg(size=("size", "sum"), was=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (totals["size"] == totals.was).all() and (abs(totals.taken / totals.target - 1) < 0.01).all()
    assert (out.taken <= 3 * out["size"]).all()
    again = mixing.mix(docs.repartition(7), block=block).toPandas().sort_values("doc_id")
    assert (again.taken.to_numpy() == out.sort_values("doc_id").taken.to_numpy()).all()
    kept = mixing.mixed(docs, block=block)
    assert kept.columns == docs.columns and kept.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == out.taken.sum()


def test_mix_of_awkward_rows(spark):
    out = mixing.mix(awkward(spark)).collect()
    assert len(out) == len(documents()) and all(0 <= r.taken <= 3 * r["size"] for r in out)
    assert {r.copies for r in out if r.doc_id == 4} and len({r.copies for r in out if r.doc_id == 4}) == 1
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
    assert set(mixing.mixed(awkward(spark)).columns) == set(awkward(spark).columns)


def test_equal_rows_share_a_target(spark):
    """Rows of equal id, text and source take their share together, though some are taken once more than others."""
    same = [(1, "four words are here", "A", "x")] * 1000
    other = [(i, "four words are here", "B", "x") for i in range(2, 1002)]
    few = [(1, "four words are here", "A", "x")] * 10 + [(i, "four words are here", "B", "x") for i in range(2, 5)]
    for rows in (same + other, few):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target string")
        out = mixing.mix(docs).toPandas()
        assert len(out) == len(rows)
        totals = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
        assert (abs(totals.taken - totals.target) <= np.maximum(4, 0.01 * totals.target)).all(), totals
        assert (out.taken <= 3 * out["size"]).all()
        again = mixing.mix(docs.repartition(5)).toPandas()
        assert sorted(zip(again.doc_id, again.taken)) == sorted(zip(out.doc_id, out.taken))
        assert mixing.mixed(docs).count() == out.copies.sum()


def test_targets_of_many_sources(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(n), f"s{int(20 * rng.random() ** 2)}" if i % 7 else None, "x") for i, n in enumerate(rng.integers(0, 60, 400))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target string")
    want = mixing.mix(docs).toPandas().sort_values("doc_id")
    monkeypatch.setattr(mixing, "COLLECTED_SOURCES", 3)
    got = mixing.mix(docs).toPandas().sort_values("doc_id")
    assert np.allclose(got.target, want.target) and (got.taken.to_numpy() == want.taken.to_numpy()).all()


# WARC

PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "same"), (4, "http://b", "Ünï\r\n\r\nx"), (5, "http://c", None), (6, "http://d", ""), (None, "http://e", "same"), (None, "http://f", "alone"), (7, "u\r\nX: y", "z" * 300_000), (7, "twice", "same7"), (7, "twice", "same7")]


def test_archive_of_pages(spark):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(PAGES, "page_id bigint, url string, html string")).collect()), key=str)
    largest = {}
    for i, _, h in PAGES:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        data, keep = (h or "").encode(), largest.get(h or "")
        again = keep is not None and i != keep
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", keep if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert {r.record_type for r in warc.archive_pages(spark.createDataFrame(PAGES, "page_id bigint, url string, html string"), 100).collect()} == {"response"}


@pytest.mark.parametrize("form", ["sl", "gzip", "plain"])
def test_reader_skips_and_pushes(spark, tmp_path, form):
    folder = tmp_path / form
    folder.mkdir()
    made = [warc.page_record(i, f"http://{'ab'[i % 2]}/{i}", (f"body {i} " * i).encode(), "D", 9, i % 3 == 0) for i in range(40)]
    wrap = {"sl": warc.member, "gzip": gzip.compress, "plain": bytes}[form]
    (folder / ("x.warc" if form == "plain" else "x.warc.gz")).write_bytes(b"".join(map(wrap, made)))
    every = warc.read_warc(spark, f"file://{folder}")
    assert every.count() == 40
    some = every.where("record_type = 'response' and target_uri like 'http://b%'")
    assert {r.record_id: bytes(r.payload) for r in some.collect()} == {f"urn:x-page:{i}": (f"body {i} " * i).encode() for i in range(40) if i % 3 and i % 2}
    bare = warc.read_warc(spark, f"file://{folder}", payload=False).where(F.col("record_type").isin("revisit"))
    assert [r.payload for r in bare.collect()] == [None] * 14
    reader = warc.WarcReader({"path": str(folder)})
    from pyspark.sql.datasource import EqualTo, IsNotNull

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), IsNotNull(("payload",)), EqualTo(("payload_bytes",), 3)]))
    assert len(left) == 2 and reader.wanted({"WARC-Type": "revisit"}) and not reader.wanted({"WARC-Type": "response"})


# Neighbours


def plain_search(ids, vectors, k, every=100):
    out = []
    for i in np.nonzero(ids % every == 0)[0]:
        d = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
        d[i] = np.inf
        order = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
        out += [(int(ids[i]), r, int(ids[j])) for r, j in enumerate(order, 1)]
    return out


@pytest.mark.parametrize("wrap", [warc.member, gzip.compress, bytes])
def test_cut_archives_are_errors(wrap):
    made = [wrap(warc.page_record(i, "http://a/b", b"body " * 40, "D", 9, False)) for i in range(2)]
    whole = b"".join(made)
    assert len(list(warc.records(pa.BufferReader(whole), lambda h: True, True))) == 2
    for at in [*range(1, len(made[0]) - 4, 7), *range(len(made[0]) + 1, len(whole) - 4, 5)]:
        for payload in (True, False):
            if wrap is gzip.compress and not payload:
                continue
            with pytest.raises(ValueError):
                list(warc.records(pa.BufferReader(whole[:at]), lambda h: True, payload))


def test_payloads_beyond_the_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    want = sorted(map(str, warc.archive_pages(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_COPIES", 0)
    assert sorted(map(str, warc.archive_pages(pages).collect())) == want


def test_a_changed_payload_is_an_error(spark, tmp_path):
    data = warc.page_record(1, "http://a/b", b"body", warc.digest(b"other"), None, False)
    (tmp_path / "x.warc").write_bytes(data)
    assert warc.read_warc(spark, f"file://{tmp_path}").count() == 1
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, f"file://{tmp_path}", "digest").collect()


# Neighbours


@pytest.mark.parametrize("exact", [False, True])
def test_neighbours(spark, exact, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 64)  # some buckets are split
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    vectors = (centres[rng.integers(0, 40, 3000)] + 0.2 * rng.standard_normal((3000, 16))).astype(np.float32)
    vectors[500:900] = vectors[500]
    vectors[900:903] *= 50
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, rank int")
    got = {(r.query_id, r["rank"], r.vec_id) for r in neighbours.search(df, exact=exact, block_bytes=1000).collect()}
    want = set(plain_search(np.arange(3000), vectors.astype(float), 10))
    assert len(got) == 300 and len({(q, v) for q, _, v in got} & {(q, v) for q, _, v in want}) >= (300 if exact else 270)


def test_recall_by_hashing_alone_and_falling_share(spark, monkeypatch):
    """Random directions, whose nearest are far: recall stays above 0.9, the share that is compared falls."""
    shares = []
    monkeypatch.setattr(neighbours, "discard", lambda df: shares.append(df.selectExpr("sum(size(queries))").first()[0]))
    rng = np.random.default_rng(2)
    for n in (500, 2000, 12_000):
        vectors = rng.standard_normal((n, 64))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
        got = {(r.query_id, r.vec_id) for r in neighbours.search(df, every=n // 50).collect()}
        want = {(q, v) for q, _, v in plain_search(np.arange(n), vectors, 10, n // 50)}
        assert len(got & want) >= 0.9 * len(want)
        shares[-1] /= n * len({q for q, _ in want})
    assert shares[0] > 1.2 * shares[1] > 2 * shares[2], shares


def test_neighbours_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [1.0, 1e-30]), (200, [3e38, 3e38]), (3, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 3), (0, 5, 200), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 3), (100, 5, 200), (200, 1, 0), (200, 2, 1), (200, 3, 2), (200, 4, 3), (200, 5, 100)]  # of distances that round to one, the smaller id
    assert neighbours.search(df.limit(0)).count() == 0
    assert [r.vec_id for r in neighbours.search(df.where("vec_id = 0")).collect()] == []


def test_rotation_keeps_lengths():
    h = neighbours.CrossPolytope(10, 3, [16, 4])
    x = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose(np.linalg.norm(h.turn(x, 0), axis=1), np.linalg.norm(x, axis=1))
    v = np.random.default_rng(1).standard_normal((50, 10))
    assert (h.probes(v, 6)[:, :, 0] == h.codes(v)).all() and (h.codes(v) == h.codes(v * 8)).all()
    assert all(len(set(p)) == 6 for row in h.probes(v, 6) for p in row)
    assert h.probes(v, 10**6).shape == (50, 3, 32 * 8) and all(len(set(p)) == 256 for row in h.probes(v, 10**6) for p in row)


def test_probes_in_order_of_what_they_lose():
    h = neighbours.CrossPolytope(16, 1, [16, 8])
    for v in np.random.default_rng(3).standard_normal((5, 16)):
        turned = [h.turn(v[None] / np.linalg.norm(v), k)[0, :a] for k, a in enumerate(h.axes)]
        both = [np.concatenate([y, -y]) for y in turned]
        loss = {a * 16 + b: both[0].max() - both[0][a] + both[1].max() - both[1][b] for a in range(32) for b in range(16)}
        assert h.probes(v[None], 40)[0, 0].tolist() == sorted(loss, key=loss.get)[:40]


def test_axes_follow_the_number_of_vectors():
    for n in (1, 2, 5, 500, 2000, 51_282, 10**6, 10**9):
        buckets = np.prod([2.0 * a for a in neighbours.axes_of(n, 64)])
        assert buckets <= max(2, n) and 4 * buckets > n


# HTML


def test_blocks_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></ul></nav><!-- <p>no --><div class="ad">Buy</div>
    <article><h1>A &amp; B&nbsp;&#233;</h1><p><b>One<br>two <i>th</i>ree<p>Four<aside>side</aside><div class="comments"><p>Reader</div><form>f<input></form><ul><li>five<li>six</ul><footer>foot</footer><table><tr><td>7<td>8</table></article><footer>&copy;</footer></body>"""
    p = htmltext.parse(page)
    assert p.article == ["A & B é", "One two three", "Four", "five", "six", "7", "8"] and p.has_article
    assert p.outside == ["Home", "Buy", "side", "Reader", "f", "foot", "©"] and not any(p.open)
    for odd in (None, "", "plain < text", "<", "<p", "<!--", "<article>x", "</p></article>y", "<div class='a>b'>q</div>"):
        htmltext.parse(odd)
    assert htmltext.parse("plain < text &am &copy").outside == ["plain < text &am ©"]


def test_suffix_array_by_sorting():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 60, 200):
        t = rng.integers(0, 3, n)
        order, levels = htmltext.suffix_array(t)
        assert order.tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
        lcp = htmltext.common_prefixes(order, levels)
        for i in range(1, n):
            a, b = t[order[i - 1] :], t[order[i] :]
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            assert lcp[i] == k
        for depth in (3, 4):
            order, levels = htmltext.suffix_array(t, depth)
            assert [t[i : i + depth].tolist() for i in order] == sorted(t[i : i + depth].tolist() for i in range(n))
            lcp = htmltext.common_prefixes(order, levels)
            assert [x >= depth for x in lcp.tolist()[1:]] == [t[a : a + depth].tolist() == t[b : b + depth].tolist() and max(a, b) + depth <= n for a, b in zip(order[:-1], order[1:])]


def plain_unmarked(rows, min_run=4):
    """Pages without an article by comparing all windows of a host's distinct pages: (page_id, text)."""
    blocks = lambda page: htmltext.parse(page)
    by_host = collections.defaultdict(set)
    for _, url, page in rows:
        by_host[url.split("/")[2]].add(page)
    out = []
    for i, url, page in rows:
        p = blocks(page)
        words = [w for b in p.blocks for w in b.split()]
        others = set()
        for other in by_host[url.split("/")[2]] - {page}:
            w = [x for b in blocks(other).blocks for x in b.split()]
            others |= {tuple(w[k : k + min_run]) for k in range(len(w) - min_run + 1)}
        covered = np.zeros(len(words), bool)
        for k in range(len(words) - min_run + 1):
            if tuple(words[k : k + min_run]) in others:
                covered[k : k + min_run] = True
        at, own, every = 0, [], []
        for b, kind in zip(p.blocks, p.kinds):
            n = len(b.split())
            if kind != htmltext.JUNK_BLOCK:
                every.append(b)
                if covered[at : at + n].mean() < 0.5:
                    own.append(b)
            at += n
        out.append((i, "\n".join(own or every)))
    return sorted(out)


def test_unmarked_pages_are_judged_over_the_whole_host(spark):
    """Menus of all pages, boxes on two pages each, mirrored pages: one answer for every size of group, that of comparing all windows."""
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 4000, n))
    boxes = [words(12) for _ in range(20)]
    rows = [(i, f"http://h{i % 3 % 2}.org/{i}", f"<body><div>Home news sport weather and more of it</div><div>{words(25)}</div><div>{boxes[i // 2]}</div><p>{words(9)}</p></body>") for i in range(40)]
    rows += [(100 + i, f"http://h{i % 3 % 2}.org/m{i}", rows[i][2]) for i in range(12)] + [(200, "http://alone.org/", rows[0][2]), (201, "http://alone.org/2", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = plain_unmarked(rows)
    assert sum("Home news" in t for _, t in want) == 2  # of a host with one page nothing is known to repeat
    for size in (10_000, 256, 16, 1):
        assert sorted((r.page_id, r.text) for r in htmltext.extract(pages, per_group=size).collect()) == want, size


def test_repeats_by_brute_force():
    rng = np.random.default_rng(1)
    pages = [[f"w{x}" for x in rng.integers(0, 4, n)] for n in (0, 3, 20, 30, 25)]
    got = htmltext.repeated(pages, 4)
    for i, words in enumerate(pages):
        want = np.zeros(len(words), bool)
        others = {tuple(o[k : k + 4]) for j, o in enumerate(pages) if j != i for k in range(len(o) - 3)}
        for k in range(len(words) - 3):
            if tuple(words[k : k + 4]) in others:
                want[k : k + 4] = True
        assert (got[i] == want).all()


def test_pages_without_an_article(spark):
    shell = "<body><div>Welcome to our lovely site of news today</div><div>{}</div><div>All rights are reserved by us alone here</div></body>"
    rows = [(i, "http://h.org/x", shell.format(f"Unique story number {i} about thing{i} and place{i}"), "x") for i in range(6)]
    rows += [(10, "http://h.org/y", "<article><p>Welcome to our lovely site of news today</article>", "x"), (11, None, None, "x"), (12, "bad url", "", "x"), (None, "http://z", "<main>m</main>", "x"), (0, "http://h.org/x", rows[0][2], "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    rows.append((100, "http://h.org/mirror", rows[0][2], "x"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    for size in (10_000, 256, 16, 2, 1):
        got = [(r.page_id, r.text) for r in htmltext.extract(pages, per_group=size).collect()]
        assert len(got) == len(rows) and (10, "Welcome to our lovely site of news today") in got and (None, "m") in got and (11, "") in got
        # the repeated row and the copy under another id and address tell nothing, and get what the page itself gets
        want = [(i, f"Unique story number {i % 100} about thing{i % 100} and place{i % 100}") for i in (0, 0, *range(1, 6), 100)]
        assert sorted(x for x in got if x[0] in (*range(6), 100)) == sorted(want), size
    assert all(r.n_chars == len(r.text) for r in htmltext.extract(pages).collect())
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_runs_on_few_pages_of_a_large_host(spark):
    """A notice on a few pages of a host is found whatever the groups' size; rows of one id or none are pages too."""
    notice = "<div>This notice stands on few pages of it</div>"
    page = lambda i: f"<body><div>Story number{i} of thing{i} at place{i} with end{i}</div>{notice if i % 13 == 0 else ''}</body>"
    rows = [(i, "http://h.org/x", page(i)) for i in range(60)] + [(70, "http://other.org/", page(13)), (None, "http://h.org/n", page(1))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = sorted(map(str, htmltext.extract(pages, per_group=256).collect()))
    assert sum("left_out=1" in r for r in want) == 5  # the notices
    for size in (100, 16, 5, 1):
        assert sorted(map(str, htmltext.extract(pages, per_group=size).collect())) == want


def plain_extract(rows):
    """The same by comparing all windows of a host's distinct pages."""
    pages = [(i, url.split("/")[2], htmltext.parse(page)) for i, url, page in rows]
    out = []
    for i, host, p in pages:
        regions = {}
        distinct = {tuple(zip(q.blocks, q.regions)): q for _, h, q in pages if h == host}.values()
        streams = [[w for b in q.blocks for w in b.split()] for q in distinct]
        windows = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in streams]
        for q, words, own in zip(distinct, streams, windows):
            others = set().union(*(w for w in windows if w is not own))
            covered = [any(tuple(words[k : k + 4]) in others for k in range(max(0, at - 3), min(at, len(words) - 4) + 1)) for at in range(len(words))]
            flags = [(kind, region) for b, kind, region in zip(q.blocks, q.kinds, q.regions) for _ in b.split()]
            mine = [(r, c) for (kind, r), c in zip(flags, covered) if kind == htmltext.ARTICLE_BLOCK]
            if mine and 1 - sum(c for _, c in mine) / len(mine) >= 0.25:
                for r in {r for r, _ in mine}:
                    n, c, m = regions.get(r, (0, 0, 0))
                    regions[r] = (n + sum(x == r for x, _ in mine), c + sum(y for x, y in mine if x == r), m + 1)
        drop = {r for r, (n, c, m) in regions.items() if m >= 3 and c >= 0.9 * n}
        out.append((i, "\n".join(b for b, kind, r in zip(p.blocks, p.kinds, p.regions) if kind == htmltext.ARTICLE_BLOCK and r not in drop)))
    return sorted(out)


def test_regions_that_repeat_in_articles_go(spark):
    """A tool bar of no telling name goes by its repeats; unique adverts go by their name; a passage that articles share and whole copies stay."""
    rng = np.random.default_rng(4)
    story = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 60))
    tools = '<div class="tools-12">Print this page or send it to friends</div>'
    rows = []
    for i in range(30):
        extra = f"<p>{PLAIN}</p>" if i % 3 == 0 else ""
        rows.append((i, f"http://h{i % 2}.org/{i}", f'<nav>Home News Sport Weather and more</nav><div class="ad">{story()[:30]}</div><article><header><h1>{story()[:20]}</h1></header>{tools}<p>{story()}</p>{extra}<p>{story()}</p></article>'))
    rows += [(100 + i, "http://h0.org/c", rows[0][2]) for i in range(3)] + [(110 + i, "http://h0.org/n", rows[0][2].replace("<nav>", f"<nav>n{i} ")) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = plain_extract(rows)
    assert not any("Print" in t for _, t in want) and sum(PLAIN in t for _, t in want) == 18
    for size in (256, 8):
        got = htmltext.extract(pages, per_group=size).collect()
        assert sorted((r.page_id, r.text) for r in got) == want and {r.left_out for r in got} == {1}


def test_names_of_boilerplate():
    junk = ["ad", "ad-slot", "site-header", "social-share-buttons", "cookie_banner", "c-ad__inner", "newsletter signup", "comment-list", "ad2 ad-2"]
    text = ["share-price", "form-factor", "social-history", "adventure", "lead", "comment-worthy-thing", ""]
    assert all(map(htmltext._junk_name, junk)) and not any(map(htmltext._junk_name, text))
    p = htmltext.parse('<header>Site</header><article><header><h1>Title</h1></header><p class="share-price">up</p><footer>f</footer></article>')
    assert p.article == ["Title", "up"] and p.outside == ["Site", "f"]


def test_passages_that_repeat_in_articles_stay(spark):
    rows = [(i, "http://h/", f"<article><h1>Title</h1><p>{PLAIN}</p><p>own{i}</p></article>") for i in range(5)]
    assert {r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()} == {f"Title\n{PLAIN}\nown{i}" for i in range(5)}


def test_boxes_on_pages_of_different_groups_go(spark):
    """Each box stands in the articles of two pages only, which lie in different groups of their host; groups decide nothing."""
    rng = np.random.default_rng(5)
    story = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    boxes = [f'<div class="more">See the offer {story(6)} of this week</div>' for _ in range(20)]
    rows = [(i, f"http://h.org/{i}", f"<article><p>{story(40)}</p>{boxes[i % 20]}<p>{story(40)}</p></article>") for i in range(40)]
    rows += [(50 + i, "http://h.org/c", rows[0][2]) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = plain_extract(rows)
    assert not any("offer" in t for _, t in want)
    for size in (256, 4, 1):
        got = htmltext.extract(pages, per_group=size).collect()
        assert sorted((r.page_id, r.text) for r in got) == want and {r.left_out for r in got} == {1}
    for ascending in ([], [0], [3, 3, 1 << 47]):
        assert htmltext.unpack(htmltext.pack(np.array(ascending, np.int64))).tolist() == ascending


def test_groups_of_a_large_host_compare_windows_in_little_room(spark):
    """A host whose articles share nothing, beside one with boxes on two pages each: the same rows as by brute force, and of most windows a few bits are shuffled."""
    from measure import shuffled_bytes

    rng = np.random.default_rng(6)
    story = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    boxes = [f'<div class="more">See the offer {story(6)} of this week</div>' for _ in range(20)]
    rows = [(i, f"http://plain.org/{i}", f"<article><h1>{story(5)}</h1><p>{story(300)}</p></article>") for i in range(200)]
    rows += [(1000 + i, f"http://h.org/{i}", f"<article><p>{story(40)}</p>{boxes[i % 20]}<p>{story(40)}</p></article>") for i in range(40)]
    rows += [(2000 + i, "http://plain.org/c", rows[i][2]) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    boxed = plain_extract([r for r in rows if "h.org" in r[1]])
    want = sorted(boxed + [(i, "\n".join(htmltext.parse(x).article)) for i, url, x in rows if "plain" in url])
    before = shuffled_bytes(spark)
    assert sorted((r.page_id, r.text) for r in htmltext.extract(pages, per_group=20).collect()) == want
    assert shuffled_bytes(spark) - before < 400_000  # the texts, and about 65,000 windows
    assert not any("offer" in t for _, t in boxed)


def test_bounds_of_regions_hold():
    """Cells that windows share by chance may only raise what a region is thought to repeat."""
    rng = np.random.default_rng(7)
    for _ in range(200):
        pages = []
        for n in rng.integers(1, 60, 6):
            lengths = rng.multinomial(n, [0.4, 0.3, 0.3])
            pages.append((rng.integers(0, 40, n), lengths, rng.integers(1, 3, 3), rng.integers(0, 2, 3)))
        table = htmltext.word_hashes([f"w{x}" for x in range(40)])
        windows = [htmltext.short_hashes(table[p[0]], 4) for p in pages]
        cells = [htmltext.window_cells(table[p[0]], 4, 500) for p in pages]
        every, n = np.unique(np.concatenate(windows)), rng.integers(0, 200)
        shared = np.sort(rng.permutation(every)[:n])
        told = np.unique(np.concatenate([c[np.isin(w, shared)] for w, c in zip(windows, cells)]))
        exact, bounds = htmltext.region_words(pages, 4, windows, shared), htmltext.region_bounds(pages, 4, cells, told)
        for region, (words, runs, count) in exact.items():
            assert bounds[region][0] >= count and bounds[region][1] >= runs - htmltext.REPEATS * words - 1e-9
