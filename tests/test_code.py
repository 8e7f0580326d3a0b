import json

import pytest

from sparkwright.operators import parse, requests, summarize
from sparkwright.plans.engine import Engine
from sparkwright.sources import files, sinks
from sparkwright.sources.store import Store
from sparkwright.streaming import incremental

CALC = '''
import os
from typing import List

def hello_world():
    """Say hello."""
    print("Hello")
    return True

class Calculator:
    """Adds."""

    def add(self, a, b):
        return a + b

    def sub(self, a, b):
        return a - b

    name = "c"
'''


def test_chunks_of_a_module():
    own = parse.ast_chunks("test.py", CALC, 3)
    assert [(c[0], c[2], c[3]) for c in own] == [("test.py:imports:2", 2, 3), ("test.py:hello_world:5", 5, 8), ("test.py:Calculator:10", 10, 19)]
    assert [c[5] for c in parse.ast_chunks("test.py", CALC)] == ["imports", "Calculator"]
    assert own[1][8] == '"""Say hello."""' and parse.ast_chunks("x.py", "# only\n") == []


def test_letters_before_a_symbol_do_not_shift_it():
    assert parse.ast_chunks("x.py", "x = 'é'; y = 1\ndef f():\n    pass\n", 0)[0][7].startswith("def f")


def test_complexity():
    import ast

    assert parse.complexity(ast.parse("if a and b or c:\n  x\nelif d:\n  y")) == 5


def test_signature_and_docstring():
    (n,) = parse.python_nodes('def f(a: int) -> int:\n    "doc"\n    return a\n')
    assert n[6] == "def f(a: int) -> int" and n[5] == "doc"


def test_scan(spark, tmp_path):
    for name, text in {"test.py": "a", "ignored.py": "", "subdir/nested.py": "b", "build/x.py": "", "large.py": "x" * (1024 * 1024 + 1), "n.txt": "", "t.ts": "c"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("ignored.py\nbuild/\n")
    got = lambda c: {r.file for r in files.scan(spark, str(tmp_path), c).collect()}
    assert got(files.Config(languages=("python",))) == {"test.py", "subdir/nested.py"}
    assert got(files.Config(languages=("typescript",))) == {"t.ts"}
    assert got(files.Config(languages=("python",), exclude_patterns=("*.py", "!test.py"))) == {"test.py"}


def test_prompts():
    r = summarize.PromptRegistry()
    assert "x = 1" in r.render("code_extractive", code="x = 1")
    with pytest.raises(ValueError):
        r.render("code_abstractive", code="x")
    with pytest.raises(KeyError):
        r.render("nope")
    assert r.delete("function_doc") and not r.delete("function_doc")
    assert {p.id for p in r.list("extractive")} == {"code_extractive"}


def test_response_lines():
    assert summarize.parse_response("head\n[id1] Summary 1\ncontinued.\n\n[id2] Summary 2.", ["id1", "id2"]) == {"id1": "Summary 1 continued.", "id2": "Summary 2."}


def test_summaries_and_failures(spark):
    rows = [(f"f.py:n{i}:{i}", "function", f"n{i}", "f.py", f"def n{i}(): pass", None, [], []) for i in range(25)]
    nodes = spark.createDataFrame(rows, "node_id string, type string, name string, file string, source_code string, docstring string, parents array<string>, children array<string>")
    done = spark.createDataFrame([("f.py:n0:0",)], "node_id string")
    out = summarize.summarize(nodes, done=done).collect()
    assert len(out) == 24 and all(r.valid and r.confidence == 1.0 for r in out) and {r.batch for r in out} == {0, 1, 2}

    def broken(prompt):
        raise ConnectionError("gone")

    assert {(r.node_id, r.error) for r in summarize.summarize(nodes, broken).collect()} == {(None, "ConnectionError: gone")}


def test_events_of_batches(spark):
    rows = [("a", 0, "x", True, 1.0, None), ("b", 0, "x", False, 0.0, None), (None, 1, None, None, None, "gone")]
    log = summarize.progress(spark.createDataFrame(rows, "node_id string, batch bigint, summary string, valid boolean, confidence double, error string")).collect()
    assert {(r.batch, r.phase, r.node_id) for r in log} == {
        (0, "batch_start", None), (0, "llm_call_start", None), (0, "llm_call_success", None), (0, "node_validated", "a"), (0, "node_invalid", "b"), (0, "batch_done", None),
        (1, "batch_start", None), (1, "llm_call_start", None), (1, "llm_call_error", None), (1, "batch_done", None),
    }
    assert {r.phase for r in log} <= set(summarize.PHASES)


def test_bad_requests():
    assert requests.context_request("q")["dependency_depth"] == 2 and requests.update_request("modify", "a.py")["content"] is None
    for bad in (lambda: requests.context_request(""), lambda: requests.context_request("q", dependency_depth=6), lambda: requests.summary_request("x", "odd"), lambda: requests.summary_request("x", temperature=2.1), lambda: requests.update_request("move", "f")):
        with pytest.raises(ValueError):
            bad()


def test_memory(spark):
    items = spark.createDataFrame([(1, "same", "abstractive", None), (2, "same", "abstractive", None), (3, "other", "odd", None)], "item_id bigint, content string, summary_type string, prompt_id string")
    out, cache = summarize.memoised(items)
    assert out.count() == 3 and cache.count() == 2 and not any(r.cached for r in out.collect())
    out, cache = summarize.memoised(items, cache=cache)
    assert all(r.cached for r in out.collect()) and cache.count() == 2


@pytest.mark.parametrize("summary,original,want", [("Hi", "x" * 50, 0.3), ("This summary is longer than that.", "short original of it", 0.4), ("one two three four five  ", "one two three four five   ", 0.2), ("abcdefghij klmnopqrst", "x" * 99, 0.4), ("one two three four five six", "y" * 99, 0.56)])
def test_quality(spark, summary, original, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(summarize.quality(F.lit(summary), F.lit(original)).alias("q")).first().q == pytest.approx(want)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    assert s.read("t") is None
    s.upsert("t", one, ["k"])
    s.upsert("t", spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int"), ["k"])
    s.delete("t", spark.createDataFrame([("a",)], "k string"), ["k"])
    assert {(r.k, r.v) for r in s.read("t").collect()} == {("b", 2), ("c", 2)}
    assert len(s.versions("t")) == 2 and s.stats().count() == 1
    s.clear()
    assert not s.exists("t")


FILES = [("a.py", "def alpha(x):\n    y = beta(x)\n    z = y\n    w = z\n    v = w\n    return v\n"), ("b.py", "def beta(x):\n    one = 1\n    two = 2\n    three = 3\n    four = 4\n    return four\n")]


def test_engine_and_stream(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "engine"))
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta three")], "query_id bigint, text string")
    assert e.search(asked).count() == 0
    assert e.index(spark.createDataFrame(FILES, "file string, text string"))["chunks"] == 2
    assert {(r.src, r.dst) for r in e.store.read("edges").collect()} == {("a.py:alpha:1", "b.py:beta:1")}
    assert e.index(spark.createDataFrame(FILES, "file string, text string"))["files"] == 0
    out = e.query(asked)
    assert {r.query_id for r in out["results"].collect()} == {1, 2}
    assert {r.is_complete for r in out["completeness"].collect()} <= {True, False}

    folder = tmp_path / "changes"
    spark.createDataFrame([("b.py", "modify", FILES[1][1].replace("three", "neu"), 1), ("a.py", "modify", "bad", 1), ("a.py", "delete", None, 2)], incremental.CHANGES).coalesce(1).write.json(str(folder))
    q = incremental.follow(e, spark.readStream.schema(incremental.CHANGES).json(str(folder)), str(tmp_path / "ck"))
    q.awaitTermination()
    assert {r.file_path for r in e.store.read("chunks").collect()} == {"b.py"}
    assert e.store.read("edges").count() == 0 and "neu" in e.store.read("chunks").first().content
    assert {r.doc_id for r in e.search(asked).collect()} == {"b.py:beta:1"}


def test_changes_mark_dependents(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "engine"))
    e.index(spark.createDataFrame(FILES, "file string, text string"))
    e.index(spark.createDataFrame([("b.py", FILES[1][1].replace("four", "vier"))], "file string, text string"))
    assert {r.node_id for r in e.store.read("nodes").where("is_dirty").collect()} == {"a.py:alpha:1", "b.py:beta:1"}


def test_report_and_exports(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "file1.py", "function", "func1", 10, 1, 2), ("n2", "file2.py", "class", "Class1", 20, 1, 2)], "node_id string, file string, type string, name string, line int, complexity int, loc int")
    pairs = spark.createDataFrame([("n1", "n2", "call")], "src string, dst string, type string")
    told = spark.createDataFrame([("n1", "Says hello.")], "node_id string, summary string")
    sinks.write_report(nodes, pairs, told, str(tmp_path / "r.md"))
    text = (tmp_path / "r.md").read_text()
    assert "func1" in text and "Class1" in text and "No summary available." in text and "**Total Dependencies**: 1" in text
    for kind in ("graphml", "gexf", "dot"):
        assert sinks.export_graph(nodes, pairs, str(tmp_path / kind), kind) and "n2" in (tmp_path / kind).read_text()
    assert not sinks.export_graph(nodes, pairs, str(tmp_path / "x"), "png")
    sinks.save_checkpoint(told, str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text()) == {"n1": "Says hello."}
    assert files.load_checkpoint(spark, str(tmp_path / "c.json")).count() == 1 and files.load_checkpoint(spark, str(tmp_path / "no")).count() == 0


def test_config(tmp_path):
    assert files.load_config().max_memory_gb == 26.0
    (tmp_path / "c.yaml").write_text("languages: [python]\nother: 1\n")
    assert files.load_config(str(tmp_path / "c.yaml")) == files.Config(languages=("python",), extra={"other": 1})


def test_contents_travel_in_batches_of_bounded_bytes(spark):
    from sparkwright.functions.batches import BATCH_BYTES

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    items = spark.createDataFrame([(1, "x", "abstractive", None)], "item_id bigint, content string, summary_type string, prompt_id string")
    assert summarize.memoised(items)[0].count() == 1 and spark.conf.get(name) == str(BATCH_BYTES)
    if before is not None:
        spark.conf.set(name, before)
