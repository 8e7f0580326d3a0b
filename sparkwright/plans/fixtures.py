"""Small inline inputs for the queries on code, as the supplied tables hold none, and the rows expected of them."""

from __future__ import annotations

APP = '''import os
from util import helper

def run(x):
    if x and os.path.exists(x):
        return helper(x)
    return None


class Base:
    pass


class App(Base):
    def start(self):
        for i in range(3):
            run(i)
        return self
'''
UTIL = '''# é
def helper(x):
    """Doc."""
    return check(x)

def check(x):
    assert x
    return x
'''
WEB = """import { x } from './lib';
export class Page extends View {
  open(id: number) {
    if (id > 0) { load(id); }
  }
}
function load(id) {
  return fetchPage(id);
}
"""
FILES = [("app.py", APP), ("util.py", UTIL), ("bad.py", "def (:\n"), ("web.ts", WEB), ("notes.txt", "def f(): pass")]
CODE = [
    ("methods", "def foo():\n    bar()\n    baz.method()\n    return MyClass()"),
    ("stop", "if (x): print(len(str(y)))"),
    ("bases", "class A(base.B, C, metaclass=M): pass"),
    ("imports", "from os import path as p, sep  # x\nfrom a import (b, c)"),
]
CHUNK_ROWS = [
    (1, "func1", "def func1(): return func2()", "func1"), (1, "func2", "def func2(): return 42", "func2"),
    (2, "func1", "def func1(): return func2()", ""), (2, "func2", "def func2(): return 42", ""),
    (3, "plain", "nothing here", "plain"),
    (4, "one", "def one(): return two(three())", "one"),
]
DEPENDENCIES = [(1, "func2"), (4, "one"), (4, "two"), (4, "six"), (4, "six")]


def values(columns: str, rows: list[tuple]) -> str:
    """A DuckDB statement of these rows."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, float):
            return f"{x!r}::DOUBLE"
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


REFERENCES_SQL = values("name, reference", [
    *(("methods", x) for x in ("MyClass", "bar", "foo", "method")),
    *(("bases", x) for x in ("A", "C", "base", "metaclass=M")),
    *(("imports", x) for x in ("(b", "c)", "import", "path", "sep")),
])
COMPLETENESS_SQL = "SELECT query_id::BIGINT AS query_id, * EXCLUDE (query_id) FROM (" + values("query_id, symbol_resolution, dependency_coverage, overall, unresolved, missing, is_complete", [
    (1, 1.0, 1.0, 1.0, "", "", True),
    (2, 0.0, 1.0, 0.3, "func1,func2", "", False),
    (3, 1.0, 1.0, 1.0, "", "", True),
    (4, 1 / 3, 1 / 3, round(0.7 / 3 + 0.1, 6), "three,two", "six,two", False),
]) + ")"
NODES_SQL = values("file, type, name, line, end_line, complexity, loc, failed", [
    ("app.py", "function", "run", 4, 7, 3, 4, False), ("app.py", "function", "start", 15, 18, 2, 4, False),
    ("app.py", "class", "Base", 10, 11, 1, 2, False), ("app.py", "class", "App", 14, 18, 2, 5, False),
    ("util.py", "function", "helper", 2, 4, 1, 3, False), ("util.py", "function", "check", 6, 8, 2, 3, False),
    ("bad.py", None, None, None, None, None, None, True),
    ("web.ts", "function", "load", 7, 9, 1, 3, False), ("web.ts", "class", "Page", 2, 6, 2, 5, False), ("web.ts", "method", "open", 3, 5, 2, 3, False),
])
EDGES_SQL = values("file, source, target, type, confidence", [
    ("app.py", "run", "exists", "call", 1.0), ("app.py", "run", "helper", "call", 1.0), ("app.py", "start", "range", "call", 1.0), ("app.py", "start", "run", "call", 1.0),
    ("app.py", "app.py", "os", "import", 0.8), ("app.py", "app.py", "util", "import", 0.8), ("app.py", "App", "Base", "inheritance", 0.9),
    ("util.py", "helper", "check", "call", 1.0),
    ("web.ts", "open", "load", "call", 1.0), ("web.ts", "load", "fetchPage", "call", 1.0), ("web.ts", "web.ts", "./lib", "import", 0.8), ("web.ts", "Page", "View", "inheritance", 0.9),
])
CHUNKS_SQL = values("chunk_id, start_line, end_line, chunk_type, symbol_name", [
    ("app.py:imports:1", 1, 2, "import", "imports"), ("app.py:run:4", 4, 7, "function", "run"), ("app.py:Base:10", 10, 11, "class", "Base"), ("app.py:App:14", 14, 18, "class", "App"),
])
PATTERN_SQL = values("chunk_id, start_line, end_line, chunk_type, symbol_name", [
    ("app.py:run:4", 4, 9, "function", "run"), ("app.py:Base:10", 10, 13, "class", "Base"), ("app.py:App:14", 14, 19, "class", "App"),
    ("util.py:helper:2", 2, 5, "function", "helper"), ("util.py:check:6", 6, 9, "function", "check"),
])
GRAPH_SQL = values("src, dst, type, weight", [
    ("app.py:run:4", "util.py:helper:2", "call", 1.0), ("app.py:start:15", "app.py:run:4", "call", 1.0), ("app.py:App:14", "app.py:Base:10", "inheritance", 0.9),
    ("util.py:helper:2", "util.py:check:6", "call", 1.0), ("web.ts:open:3", "web.ts:load:7", "call", 1.0),
])


def _rows(text: str, a: int, b: int) -> str:
    return "\n".join(text.split("\n")[a - 1 : b])


def shout(prompt: str) -> str:
    """A generator whose answer is the prompt with louder e's."""
    return prompt.replace("e", "E")


def unreachable(*_):
    raise ConnectionError("no server")


RUN, CHECK, HELPER = _rows(APP, 4, 7), _rows(UTIL, 6, 8), _rows(UTIL, 2, 4)
CONTENTS = [
    ("app.py:imports:1", _rows(APP, 1, 2)), ("app.py:run:4", RUN), ("app.py:Base:10", _rows(APP, 10, 11)), ("app.py:App:14", _rows(APP, 14, 18)),
    ("util.py:helper:2", HELPER), ("util.py:check:6", CHECK),
]
ASKED = [(1, "helper check x"), (2, "App base class"), (3, "unknown words"), (4, "return self, return")]
CONTENTS_ASKED = [(1, RUN), (2, CHECK)]
ANSWER_ASKED = [(1, "helper check")]
COMPLEXITY_SQL = "SELECT file, complexity::BIGINT AS complexity, n_nodes::BIGINT AS n_nodes FROM (" + values("file, complexity, n_nodes", [("app.py", 8, 4), ("util.py", 3, 2), ("web.ts", 5, 3), ("bad.py", 0, 0)]) + ")"
NODE_TEXT_SQL = values("name, source_code, docstring, signature", [("helper", HELPER, "Doc.", "def helper(x)"), ("check", CHECK, None, "def check(x)")])
CHUNK_PARTS_SQL = values("chunk_id, imports, calls, inherits, docstring, complexity, digested", [
    ("app.py:imports:1", "import os,from util import helper", "", "", None, 1, True), ("app.py:run:4", "", "os.path.exists,helper", "", None, 3, True),
    ("app.py:Base:10", "", "", "", None, 1, True), ("app.py:App:14", "", "", "Base", None, 2, True),
    ("util.py:helper:2", "", "check", "", '"""Doc."""', 1, True), ("util.py:check:6", "", "", "", None, 2, True),
])
ROWS_SQL = values("chunk_id, chars, metadata", [
    ("app.py:imports:1", len(CONTENTS[0][1]), "app.py|import|imports|1|2"), ("app.py:run:4", len(RUN), "app.py|function|run|4|7"),
    ("app.py:Base:10", len(CONTENTS[2][1]), "app.py|class|Base|10|11"), ("app.py:App:14", len(CONTENTS[3][1]), "app.py|class|App|14|18"),
])
ENGINE_SQL = values("chunk_id, symbol_name", [("util.py:helped:2", "helped"), ("util.py:check:6", "check")])
STREAM_SQL = values("chunk_id, symbol_name", [("util.py:helper:2", "helper"), ("util.py:check:6", "check")])
_STATS = dict(files=5, bytes=sum(len(t.encode()) for _, t in FILES), chunks=6, vectors=6, nodes=6, dirty=0, edges=3)
STATS_SQL = "SELECT " + ", ".join(f"{n}::BIGINT AS {k}" for k, n in _STATS.items())
CONTENT_SQL = f"chunk AS ({values('chunk_id, content', CONTENTS)}), asked AS (SELECT query_id::BIGINT AS query_id, text FROM ({values('query_id, text', ASKED)}))"
SEMANTIC_SQL = f"chunk AS ({values('chunk_id, content', CONTENTS)}), asked AS (SELECT query_id::BIGINT AS query_id, text FROM ({values('query_id, text', CONTENTS_ASKED)}))"
ANSWER_SQL = "SELECT query_id::BIGINT AS query_id, * EXCLUDE (query_id) FROM (" + values("query_id, symbol_resolution, dependency_coverage, unresolved", [(1, 5 / 7, 1.0, "exists,start")]) + ")"
PROMPTS_SQL = values("id, name, variables", [("code_abstractive", "Code Abstractive Summary", "code,context"), ("mine", "Mine", "x")])
