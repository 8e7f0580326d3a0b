import numpy as np
import pytest

from sparkwright.operators import backends, dense, summarize
from sparkwright.sources import files
from sparkwright.sources.store import Store


def chat(path, payload):
    assert path == "/chat/completions" and payload["messages"][1]["content"] == "hello"
    if payload["stream"]:
        return iter([{"choices": [{"delta": {"content": x}}]} for x in ("a", "", "b")])
    return {"choices": [{"message": {"content": "ab"}}]}


def messages(path, payload):
    if payload["stream"]:
        return iter([{"type": "message_start"}, {"type": "content_block_delta", "delta": {"text": "a"}}, {"type": "content_block_delta", "delta": {"text": "b"}}])
    return {"content": [{"type": "text", "text": "a"}, {"type": "other"}, {"type": "text", "text": "b"}]}


@pytest.mark.parametrize(("kind", "transport"), [("chat", chat), ("messages", messages)])
def test_answers_and_streams(kind, transport):
    b = backends.create_backend(kind, model="m", transport=transport)
    assert b.generate("hello") == "ab" and list(b.stream("hello")) == ["a", "b"]


def test_named_backends():
    def broken(path, payload):
        raise OSError("down")

    own = backends.Backends("chat", {"chat": backends.create_backend("chat", model="m", transport=broken)})
    assert own.health() == {"status": "unhealthy", "backends": {"chat": False}, "n_healthy": 0}
    own.known["echo"] = backends.create_backend("echo")
    assert own.health()["status"] == "healthy" and own.get().name == "chat" and "".join(own.get("echo").stream("some words")) == "some words"
    with pytest.raises(KeyError):
        own.get("other")
    with pytest.raises(ValueError, match="backend"):
        backends.create_backend("other")


def test_a_disabled_run_is_taken_up(spark, tmp_path):
    none = [(f"n{i:02}", "function", f"name{i}", "f", "source", None, [], []) for i in range(25)]
    nodes = spark.createDataFrame(none, "node_id string, type string, name string, file string, source_code string, docstring string, parents array<string>, children array<string>")
    tables = Store(spark, f"file://{tmp_path}/s")

    def fails_late(prompt):
        if "name15" in prompt:
            raise ConnectionError("gone")
        return summarize.echo_generator(prompt)

    events = summarize.run(nodes, tables, fails_late, batch_size=5, cadence=2).collect()
    assert tables.read("summaries").count() == 15 and sorted(e.batch for e in events if e.phase == "disabled") == [4]
    assert [e.batch for e in events if e.phase == "llm_call_error"] == [3]
    assert {e.phase for e in summarize.run(nodes, tables, batch_size=5, cadence=2).collect()} == {"batch_start", "llm_call_start", "llm_call_success", "node_validated", "batch_done"}
    assert tables.read("summaries").count() == 25 and summarize.run(nodes, tables).count() == 0


def test_a_long_run_takes_few_steps(spark, tmp_path):
    none = [(f"n{i:03}", "function", f"name{i}", "f", "source", None, [], []) for i in range(80)]
    nodes = spark.createDataFrame(none, "node_id string, type string, name string, file string, source_code string, docstring string, parents array<string>, children array<string>")
    tables = Store(spark, f"file://{tmp_path}/s")
    assert summarize.run(nodes, tables, batch_size=2, cadence=1).where("phase = 'batch_done'").select("batch").distinct().count() == 40
    assert tables.read("summaries").count() == 80 and tables.versions("summaries")[-1] == 7  # waves 1, 1, 2, 4, 8, 16, 8

    def gone(prompt):
        raise ConnectionError("gone")

    # one task: after the error of the first batch of a step no later wave of it is called
    rows = spark.createDataFrame([(f"n{i}", "x", "p", i // 2) for i in range(12)], "node_id string, name string, part string, batch bigint").coalesce(1)
    errors = sorted((r.batch, r.error) for r in summarize._called(rows, gone, 2, 1).collect())
    assert errors == [(0, "ConnectionError: gone"), (1, "ConnectionError: gone"), *((i, summarize.DISABLED) for i in range(2, 6))]


def test_inverted_file_search(spark):
    assert (dense.cells_of(0), dense.cells_of(30), dense.cells_of(3900), dense.cells_of(10**6)) == (1, 1, 100, 4000)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((60, 8))
    v = centres[rng.integers(0, 60, 4000)] + 0.2 * rng.standard_normal((4000, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    own = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id bigint, vec array<double>")
    index, cells = dense.ivf_build(own)
    assert index.count() == 4000 and len(cells) == 102
    asked = own.where("doc_id < 20").withColumnRenamed("doc_id", "query_id")
    exact = {(r.query_id, r.doc_id) for r in dense.inner_product_top_k(asked, own, 10).collect()}
    near = {(r.query_id, r.doc_id) for r in dense.ivf_top_k(asked, index, cells, 10, nprobe=20).collect()}
    assert len(near) == 200 and len(near & exact) >= 180
    assert dense.ivf_build(own.limit(0))[0].count() == 0


def test_lists_by_suffix(spark, tmp_path):
    for name in ("a.py", "b.txt", "venv/c.py", "venv/deep/d.py"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    rows = spark.createDataFrame([("a.py",), ("b.txt",), ("venv/c.py",), ("venv/deep/d.py",), ("x/test_e.py",)], "file string")
    assert sorted(r.file for r in files.by_extension(rows, (".py",), ("**/venv/**", "test_*.py")).collect()) == ["a.py", "venv/deep/d.py"]
    assert files.unreadable(spark, f"file://{tmp_path}").count() == 0
