"""The jobs on copies of growing input, and the packing and running sums that they use."""

import collections
import json
import os
import random
import shutil
import subprocess
import sys
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import catalog, keyword_index, prompt_batches
from sparkwright.functions.ordering import running_sums
from sparkwright.operators import packing

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def put(spark, rows, folder):
    """One more file of documents in the folder."""
    made = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).coalesce(1)
    made.write.mode("append").parquet(folder)
    time.sleep(1.1)  # versions are told apart by the file's second


def files_of(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def uncommit(mark, batch):
    for name in (f"{mark}/commits/{batch}", f"{mark}/commits/.{batch}.crc"):
        if os.path.exists(name):
            os.remove(name)


def plain_index(texts):
    out = []
    for i, t in texts.items():
        words = [w for w in "".join(c.lower() if c.isalnum() or c == "_" else " " for c in t or "").split()]
        out += [(i, w, n, len(words)) for w, n in collections.Counter(words).items()]
    return sorted(out, key=str)


def indexed(spark, out):
    return rows_of(keyword_index.current(spark, out).drop("bucket"))


# Keyword index


def test_index_takes_only_what_is_new(spark, tmp_path):
    docs, out, mark = (f"{tmp_path}/{x}" for x in ("docs", "index", "mark"))
    first = [(1, "One fish two fish", "a"), (2, "Blue fish", "b"), (3, None, "a"), (4, "", None), (None, "no id", "a")]
    put(spark, first, docs)
    assert keyword_index.run(spark, docs, out, mark)["read"] == 5
    texts = {i: t for i, t, _ in first if i is not None}
    assert indexed(spark, out) == plain_index(texts)
    before = files_of(out)
    assert keyword_index.run(spark, docs, out, mark)["read"] == 0 and files_of(out) == before

    put(spark, [(2, "Green fish now", "b"), (1, "One fish two fish", "a"), (5, "new new document", "c")], docs)
    assert keyword_index.run(spark, docs, out, mark)["read"] == 3
    texts |= {2: "Green fish now", 5: "new new document"}
    assert indexed(spark, out) == plain_index(texts)
    # what was there stays as it was; the unchanged document 1 was not indexed again
    after = files_of(out)
    assert before.items() <= after.items()
    assert {r[0] for r in spark.read.schema(keyword_index.CATALOGUE).parquet(f"{out}/documents").where("batch > 0").select("doc_id").collect()} == {2, 5}

    # in one go over the same files, by two a batch, the index is the same
    keyword_index.run(spark, docs, f"{tmp_path}/again", f"{tmp_path}/mark2", {"max_files": 1})
    assert indexed(spark, f"{tmp_path}/again") == plain_index(texts)


def test_a_batch_that_is_replayed_does_no_harm(spark, tmp_path):
    docs, out, mark = (f"{tmp_path}/{x}" for x in ("docs", "index", "mark"))
    put(spark, [(i, f"word{i} common", "a") for i in range(20)], docs)
    keyword_index.run(spark, docs, out, mark)
    put(spark, [(i, f"word{i} changed", "a") for i in range(10, 30)], docs)
    keyword_index.run(spark, docs, out, mark)
    want, n = indexed(spark, out), len(files_of(out))
    # as if the second run had ended after it wrote and before it was committed
    uncommit(mark, 1)
    assert keyword_index.run(spark, docs, out, mark)["read"] == 20
    assert indexed(spark, out) == want and len(files_of(out)) == n
    # as if it had ended between the two tables
    uncommit(mark, 1)
    shutil.rmtree(f"{out}/documents/batch=1")
    keyword_index.run(spark, docs, out, mark)
    assert indexed(spark, out) == want


def test_an_empty_table_gives_an_empty_index(spark, tmp_path):
    put(spark, [], f"{tmp_path}/docs")
    found = keyword_index.run(spark, f"{tmp_path}/docs", f"{tmp_path}/index", f"{tmp_path}/mark")
    assert found == {"read": 0, "documents": 0, "postings": 0}


# Prompt batches


def test_prompts_are_asked_once_and_fit_their_batches(spark, tmp_path):
    rng, docs, out = random.Random(1), f"{tmp_path}/docs", f"{tmp_path}/out"
    rows = [(i, "x" * rng.choice([0, 10, 300, 900, 2000, 5000]) + str(i % 150), rng.choice(["a", "b", None])) for i in range(300)] + [(None, None, "a"), (301, "", "b")]
    put(spark, rows, docs)
    conf = {"budget": 500}
    found = prompt_batches.run(spark, docs, out, conf)
    made = prompt_batches.output(spark, out).collect()
    assert found["written"] == len(made) == len(rows) == found["read"]
    by_key = collections.defaultdict(list)
    for r in made:
        by_key[r.cache_key].append(r)
    assert all(sum(r.asked for r in own) == 1 for own in by_key.values()) and found["prompts"] == len(by_key)
    sums = collections.Counter()
    for r in made:
        if r.asked:
            assert r.tokens == len(r.prompt) // 4
            sums[r.source, r.kind, r.batch] += r.tokens
    assert all(n <= 500 for (_, kind, _), n in sums.items() if kind != "over") and found["batches"] == len(sums)
    first = rows_of(prompt_batches.output(spark, out))
    prompt_batches.run(spark, docs, out, conf)
    assert rows_of(prompt_batches.output(spark, out)) == first
    # over grown input the output is that of the whole
    put(spark, [(1000, "later", "z"), (1001, "later", "a")], docs)
    prompt_batches.run(spark, docs, out, conf)
    prompt_batches.run(spark, docs, f"{tmp_path}/whole", conf)
    assert rows_of(prompt_batches.output(spark, out)) == rows_of(prompt_batches.output(spark, f"{tmp_path}/whole"))


@pytest.mark.parametrize("name", ["keyword_index", "prompt_batches"])
def test_command_line(spark, tmp_path, name):
    put(spark, [(i, f"some text {i}", "a") for i in range(5)], f"{tmp_path}/docs")
    more = ["--checkpoint", f"{tmp_path}/mark"] if name == "keyword_index" else []
    args = [sys.executable, "-m", f"jobs.{name}", "--documents", f"{tmp_path}/docs", "--out", f"{tmp_path}/out", "--config", f"{ROOT}/jobs/{name}.json", *more]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    done = subprocess.run(args, cwd=ROOT, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.strip().split("\n")[-1])["read"] == 5


def test_jobs_agree_with_their_statements(spark, small):
    if not os.path.isdir(small):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    for name, q in catalog.QUERIES.items():
        df = q(spark, small)
        cursor = con.execute(catalog.ORACLES[name])
        found = [d[0] for d in cursor.description]
        assert sorted(found) == sorted(df.columns)
        assert rows_of(df.select(*found)) == sorted(cursor.fetchall(), key=str), name


# Packing and running sums


def test_running_sums_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(10)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i bigint, v bigint").repartition(7)
    got = {(r.g, r.i): r.before for r in running_sums(df, ["g"], ["i"], "v").collect()}
    so_far = collections.Counter()
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        assert got[g, i] == so_far[g]
        so_far[g] += v


def test_no_batch_is_over_budget_and_most_are_half_full(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 0, 1, 30, 90, 100, 150, 101, 240, 260, 400, 399, 401, 1000])) for i in range(3000)]
    made = packing.pack(spark.createDataFrame(rows, "folder string, item_id bigint, tokens bigint"), 400).collect()
    assert len(made) == len(rows) and {r.kind for r in made} == set(packing.KINDS)
    sums, folders = collections.Counter(), collections.Counter()
    for r in made:
        sums[r.folder, r.kind, r.batch] += r.tokens or 0
        folders[r.folder] += r.tokens or 0
    assert all((n > 400) == (kind == "over") for (_, kind, _), n in sums.items())
    for f, total in folders.items():
        assert sum(1 for g, _, _ in sums if g == f) <= 2 * total / 400 + 2
    assert packing.pack(spark.createDataFrame([], "folder string, item_id bigint, tokens bigint"), 400).count() == 0
    assert F and packing.pack(spark.createDataFrame([(None, None, 5)], "folder string, item_id bigint, tokens bigint"), 4).first().kind == "over"
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame(rows, "folder string, item_id bigint, tokens bigint"), 3)
