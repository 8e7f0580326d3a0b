"""Source files to symbols, references and chunks, as table-valued functions over batches of files.

Python goes through the standard library's ast; a file that it rejects gives an error row and, when
chunked, falls back to the pattern form. TypeScript and JavaScript have no parser here: patterns find
their top-level forms, classes and methods.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = (
    "file string, ordinal int, type string, name string, line int, end_line int, source_code string, docstring string, signature string, complexity int, loc int, error string"
)
EDGES = "file string, ordinal int, source string, target string, type string, confidence double"
CHUNKS = (
    "chunk_id string, file_path string, start_line int, end_line int, chunk_type string, symbol_name string, signature string, content string, docstring string, "
    "imports array<string>, calls array<string>, inherits array<string>, complexity int, fingerprint string"
)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert)


def line_count(source: str) -> int:
    bare = (x.strip() for x in source.splitlines())
    return sum(1 for x in bare if x and not x.startswith(("#", "//")))


def complexity(node: ast.AST) -> int:
    """1 and one more for each branch below, nested definitions too; a chain of n operands counts n - 1."""
    total = 1
    for x in ast.walk(node):
        if isinstance(x, BRANCHES):
            total += 1
        elif isinstance(x, ast.BoolOp):
            total += len(x.values) - 1
    return total


class Source:
    """A file's text with positions by line and byte column, as ast gives them."""

    def __init__(self, text: str):
        self.text, self.lines = text, text.encode("utf-8", "replace").splitlines(keepends=True)

    def cut(self, a: tuple[int, int], b: tuple[int, int]) -> str:
        rows = self.lines[a[0] - 1 : b[0]]
        if not rows:
            return ""
        rows[-1] = rows[-1][: b[1]]
        rows[0] = rows[0][a[1] :]
        return b"".join(rows).decode("utf-8", "replace")

    def of(self, node) -> str:
        return self.cut((node.lineno, node.col_offset), (node.end_lineno, node.end_col_offset))

    def signature(self, node) -> str:
        first = node.body[0]
        decorated = getattr(first, "decorator_list", None)
        start = decorated[0] if decorated else first
        head = self.cut((node.lineno, node.col_offset), (start.lineno, start.col_offset - bool(decorated)))
        return head.strip().rstrip(":").rstrip("{")

    def docstring(self, node) -> str | None:
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            return self.of(first.value)
        return None


def python_nodes(text: str) -> list[tuple]:
    """(type, name, line, end_line, source, docstring, signature, complexity, loc): functions in file order, then classes."""
    tree, source = ast.parse(text), Source(text)
    found = sorted((x for x in ast.walk(tree) if isinstance(x, (*FUNCTIONS, ast.ClassDef))), key=lambda x: (isinstance(x, ast.ClassDef), x.lineno, x.col_offset))
    out = []
    for x in found:
        doc, own = source.docstring(x), source.of(x)
        kind = "class" if isinstance(x, ast.ClassDef) else "function"
        out.append((kind, x.name, x.lineno, x.end_lineno, own, doc.strip("\"'") if doc else None, source.signature(x), complexity(x), line_count(own)))
    return out


def python_edges(file: str, text: str) -> list[tuple]:
    """(source, target, type, confidence): calls, imports and bases. A source is the nearest enclosing definition's name."""
    calls, imports, bases = [], [], []

    def visit(node: ast.AST, scope: str) -> None:
        if isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                calls.append((scope, name, "call", 1.0))
        elif isinstance(node, ast.Import):
            imports.extend((file, a.name, "import", 0.8) for a in node.names if a.asname is None)
        elif isinstance(node, ast.ImportFrom) and not node.level and node.module:
            imports.append((file, node.module, "import", 0.8))
        elif isinstance(node, ast.ClassDef):
            bases.extend((node.name, b.id, "inheritance", 0.9) for b in node.bases if isinstance(b, ast.Name))
        inner = node.name if isinstance(node, (*FUNCTIONS, ast.ClassDef)) else scope
        for child in ast.iter_child_nodes(node):
            visit(child, inner)

    visit(ast.parse(text), "global")
    return calls + imports + bases


TS_FUNCTION = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+([A-Za-z_$][\w$]*)", re.M)
TS_CLASS = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([A-Za-z_$][\w$]*))?", re.M)
TS_METHOD = re.compile(r"(?:^|[{;}])[ \t]*(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*([A-Za-z_$][\w$]*)\s*\([^()]*\)\s*(?::\s*[^{};]+)?\{", re.M)
TS_CALL = re.compile(r"(?:\.\s*)?\b([A-Za-z_$][\w$]*)\s*\(")
TS_IMPORT = re.compile(r"^[ \t]*import\s+(?:[^'\"\n]*\s+from\s+)?['\"]([^'\"]+)['\"]", re.M)
TS_WORDS = frozenset("if for while switch catch function return typeof await new super constructor import".split())
TS_BRANCH = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?")


def _ts_end(text: str, at: int) -> int:
    """After the brace that closes the first one opened from `at`; strings and comments are not looked into."""
    start = text.find("{", at)
    if start < 0:
        return len(text)
    level = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        level += 1 if m[0] == "{" else -1
        if not level:
            return m.end()
    return len(text)


def ts_nodes(text: str) -> list[tuple]:
    """As python_nodes(): functions, then classes, then methods of classes, by pattern."""
    row = lambda at: text.count("\n", 0, at) + 1

    def one(kind: str, name: str, at: int) -> tuple:
        end = _ts_end(text, at)
        own = text[at:end].lstrip()
        return kind, name, row(end) - own.count("\n"), row(end), own, None, own.partition("{")[0].strip(), 1 + len(TS_BRANCH.findall(own)), line_count(own)

    out = [one("function", m[1], m.start()) for m in TS_FUNCTION.finditer(text)]
    classes = [(m[1], m.start(), _ts_end(text, m.start())) for m in TS_CLASS.finditer(text)]
    out += [one("class", name, at) for name, at, _ in classes]
    for _, at, end in classes:
        body = text.find("{", at)
        out += [one("method", m[1], m.start(1)) for m in TS_METHOD.finditer(text, body, end) if m[1] not in TS_WORDS - {"constructor"}]
    return out


def ts_edges(file: str, text: str) -> list[tuple]:
    spans = [(n[1], n[2], n[3]) for n in ts_nodes(text)]

    def scope(at: int) -> str:
        row = text.count("\n", 0, at) + 1
        inside = [s for s in spans if s[1] <= row <= s[2]]
        return min(inside, key=lambda s: s[2] - s[1])[0] if inside else "global"

    defined = {m.start(1) for p in (TS_FUNCTION, TS_METHOD) for m in p.finditer(text)}
    out = [(scope(m.start()), m[1], "call", 1.0) for m in TS_CALL.finditer(text) if m[1] not in TS_WORDS and m.start(1) not in defined]
    out += [(file, m[1], "import", 0.8) for m in TS_IMPORT.finditer(text)]
    return out + [(m[1], m[2], "inheritance", 0.9) for m in TS_CLASS.finditer(text) if m[2]]


def language(file: str) -> str | None:
    suffix = file.rpartition("/")[2].rpartition(".")
    return {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript"}.get(suffix[2].lower()) if suffix[1] else None


def nodes(files: DataFrame) -> DataFrame:
    """files(file, text) -> NODES; a file that can't be read or parsed gives one row with an error, one of another language none."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for file, text in zip(pdf["file"], pdf["text"]):
                kind = language(file)
                if not kind:
                    continue
                try:
                    if text is None:
                        raise ValueError("no text")
                    rows += [(file, i, *n, None) for i, n in enumerate(python_nodes(text) if kind == "python" else ts_nodes(text))]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((file, 0, *[None] * 9, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])

    return files.select("file", "text").mapInPandas(work, NODES)


def edges(files: DataFrame) -> DataFrame:
    """files(file, text) -> EDGES: unresolved references by name; files in error give none."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for file, text in zip(pdf["file"], pdf["text"]):
                kind = language(file)
                try:
                    found = python_edges(file, text) if kind == "python" else ts_edges(file, text) if kind else []
                except (SyntaxError, ValueError, TypeError, RecursionError):
                    found = []
                rows += [(file, i, *e) for i, e in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EDGES.split(", ")])

    return files.select("file", "text").mapInPandas(work, EDGES)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def _calls(node: ast.AST, source: Source) -> list[str]:
    """Full callee texts in the order in which the calls begin, outer ones first."""
    found = [x for x in ast.walk(node) if isinstance(x, ast.Call)]
    found.sort(key=lambda x: (x.lineno, x.col_offset, -x.end_lineno, -x.end_col_offset))
    return [source.of(x.func) for x in found]


def ast_chunks(file: str, text: str, min_lines: int = 5, docstrings: bool = True) -> list[tuple]:
    """The top-level imports as one chunk, then functions and classes, not those inside other ones. Functions of min_lines lines or fewer are left out."""
    tree, source = ast.parse(text), Source(text)
    out = []
    top = [x for x in tree.body if isinstance(x, (ast.Import, ast.ImportFrom))]
    if top:
        own = [source.of(x) for x in top]
        content = "\n".join(own)
        a, b = top[0].lineno, top[-1].end_lineno
        out.append((f"{file}:imports:{a}", file, a, b, "import", "imports", "", content, None, own, [], [], 1, _digest(content)))

    def visit(node: ast.AST) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (*FUNCTIONS, ast.ClassDef)):
                a, b, content = x.lineno, x.end_lineno, source.of(x)
                is_class = isinstance(x, ast.ClassDef)
                if is_class or b - a >= min_lines:
                    calls = [] if is_class else _calls(x, source)
                    bases = [t.id for t in x.bases if isinstance(t, ast.Name)] if is_class else []
                    doc = source.docstring(x) if docstrings else None
                    kind = "class" if is_class else "function"
                    out.append((f"{file}:{x.name}:{a}", file, a, b, kind, x.name, content.split("\n")[0], content, doc, [], calls, bases, complexity(x), _digest(content)))
            else:
                visit(x)

    visit(tree)
    return out


OPENING = re.compile(r"^(\s*)(def|class)\s+(\w+)\s*([:(])")


def pattern_chunks(file: str, text: str) -> list[tuple]:
    """Without a parser: a definition's block runs to the next line, not blank, that is not indented further, in spaces."""
    lines, out, at = text.split("\n"), [], 0
    while at < len(lines):
        m = OPENING.match(lines[at])
        if not m or (m[2] == "def" and m[4] != "("):
            at += 1
            continue
        deep, end = " " * (len(m[1]) + 1), at + 1
        while end < len(lines) and (not lines[end].strip() or lines[end].startswith(deep)):
            end += 1
        content = "\n".join(lines[at:end])
        kind = "function" if m[2] == "def" else "class"
        out.append((f"{file}:{m[3]}:{at + 1}", file, at + 1, end, kind, m[3], lines[at].strip(), content, None, [], [], [], 1, _digest(content)))
        at = end
    return out


def chunks(files: DataFrame, use_ast: bool = True, min_lines: int = 5, docstrings: bool = True) -> DataFrame:
    """files(file, text) -> CHUNKS. Null texts give none; what ast rejects is chunked by pattern."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for file, text in zip(pdf["file"], pdf["text"]):
                if text is None:
                    continue
                try:
                    found = ast_chunks(file, text, min_lines, docstrings) if use_ast else pattern_chunks(file, text)
                except (SyntaxError, ValueError, RecursionError):
                    found = pattern_chunks(file, text)
                rows += found
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return files.select("file", "text").mapInPandas(work, CHUNKS)


def complexity_by_file(nodes: DataFrame) -> DataFrame:
    """nodes() rows -> (file, complexity, n_nodes): the sum over a file's nodes, inner ones too; 0 for a file in error."""
    return nodes.groupBy("file").agg(F.coalesce(F.sum("complexity"), F.lit(0)).cast("bigint").alias("complexity"), F.count("name").alias("n_nodes"))


def index_rows(chunks: DataFrame) -> DataFrame:
    """chunks() rows as an index keeps them: (chunk_id, content, metadata struct of file, lines, type and name)."""
    meta = F.struct("file_path", "start_line", "end_line", "chunk_type", "symbol_name")
    return chunks.select("chunk_id", "content", meta.alias("metadata"))
