"""A Merkle manifest of a table: a tree for each group, a tree over the groups' roots, a proof for each row.

Leaves are hashed where the rows are read; only hashes and ids move. They are sorted by range over group
and order, so each partition holds runs of consecutive leaves. Their places follow from the partitions' row
counts: all but the first group of a partition begin there, and what lies before the first one is a sum over
earlier partitions. A partition cuts its runs into complete aligned subtrees of arity^HEIGHT leaves at most
and builds each of them locally; near the ends of a run the subtrees are small, down to single leaves. Their
roots are shuffled by coordinate: all nodes below one node some HEIGHT levels up meet in one task, where that
node and the siblings on the way are worked out. A few such rounds reach the root of the largest group (four
for 2^40 leaves), and no task gets more than arity^HEIGHT nodes of a tree at once. The siblings of all rounds
go back to the subtrees, a row for each, and are unfolded into the leaves' proofs last.

The tree over the groups' roots is built by the same steps, as a forest of one tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import bounded_batches, col, shared_folder, stored

ARITY = 2
#: Levels of a subtree that is built in one place.
HEIGHT = 10
_NODE = ["grp", "level", "idx"]
_TILE = "grp binary, level int, idx bigint, node binary, keys array<string>, leaves array<binary>, others array<binary>"
_ROUND = "grp binary, total bigint, level int, idx bigint, node binary, path binary, up_level int, up_idx bigint"
_PROOF = "key string, leaf binary, other binary, idx bigint, path binary"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def node_hash(parts: list[bytes]) -> bytes:
    """SHA-256 of the parts' concatenated lower-case hexadecimal text."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def width(level: int, total: int, arity: int) -> int:
    """Nodes of a level in a tree of that many leaves."""
    return -(-total // arity**level)


def tree_height(total: int, arity: int) -> int:
    level = 0
    while width(level, total, arity) > 1:
        level += 1
    return level


def fold(node: bytes, idx: int, total: int, path: bytes, arity: int = ARITY) -> bytes:
    """The root that a leaf (or a lower root) at this place and its siblings, 32 bytes each, level by level, left to right, give."""
    at = 0
    while total > 1:
        own = idx % arity
        others = min(arity, total - (idx - own)) - 1
        run = [path[at + 32 * i : at + 32 * (i + 1)] for i in range(others)]
        run.insert(own, node)
        node, idx, total, at = node_hash(run), idx // arity, width(1, total, arity), at + 32 * others
    return node


def tiles(start: int, end: int, total: int, arity: int, height: int) -> Iterator[tuple[int, int, int, int]]:
    """(level, index, start, end) of the largest complete aligned subtrees of `height` levels at most that fill start..end in a tree of `total` leaves."""
    top = min(height, tree_height(total, arity))
    while start < end:
        level = 0
        while level < top and start % arity ** (level + 1) == 0 and min(start + arity ** (level + 1), total) <= end:
            level += 1
        upto = min(start + arity**level, total)
        yield level, start // arity**level, start, upto
        start = upto


def levels_of(leaves: list[bytes], level: int, arity: int) -> list[list[bytes]]:
    """All levels of a subtree, its root the last."""
    out = [leaves]
    for _ in range(level):
        out.append([node_hash(out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(levels: list[list[bytes]], i: int, arity: int) -> bytes:
    """Of the subtree's i-th leaf, up to its root."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % arity
        out += nodes[first:i] + nodes[i + 1 : first + arity]
        i //= arity
    return b"".join(out)


def _runs(values: pa.Array) -> Iterator[tuple[bytes, int]]:
    """Values and lengths of the runs of equal values."""
    encoded, at = pc.run_end_encode(values), 0
    for value, end in zip(encoded.values.to_pylist(), encoded.run_ends.to_pylist()):
        yield value, end - at
        at = end


def _sorted_leaves(leaves: DataFrame) -> DataFrame:
    """In ranges; rows that are equal so far are told apart to spread them. Checkpointed, as another run might cut the ranges elsewhere."""
    spark = leaves.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    order = ["grp", "ord", "leaf", "salt"]
    salted = leaves.withColumn("salt", F.monotonically_increasing_id() % 1024)
    return salted.repartitionByRange(*order).sortWithinPartitions(*order).select("grp", "key", "leaf", "other", "name").checkpoint()


def _offsets(leaves: DataFrame) -> dict[int, tuple[int, int]]:
    """By partition: the leaves of its first group that lie before it, and the size of its last group. One row for each partition is collected."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        n_first = n_last = groups = 0
        for b in batches:
            for g, n in _runs(b.column(0)):
                if g != last:
                    groups, last, n_last, first = groups + 1, g, 0, first or g
                n_last += n
                n_first += n * (groups == 1)
        if groups:
            row = (TaskContext.get().partitionId(), first, n_first, last, n_last, groups)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["p", "first", "n_first", "last", "n_last", "groups"]).cast(kinds)

    kinds = pa.schema([("p", pa.int32()), ("first", pa.binary()), ("n_first", pa.int64()), ("last", pa.binary()), ("n_last", pa.int64()), ("groups", pa.int64())])
    rows = sorted(leaves.select("grp").mapInArrow(summary, "p int, first binary, n_first bigint, last binary, n_last bigint, groups bigint").collect())
    before: dict[int, int] = {}
    size: dict[bytes, int] = {}
    last, carried = None, 0
    for r in rows:
        before[r.p] = carried if bytes(r.first) == last else 0
        carried, last = r.n_last + before[r.p] * (r.groups == 1), bytes(r.last)
        size[bytes(r.first)] = before[r.p] + r.n_first
        size[last] = carried
    return {r.p: (before[r.p], size[bytes(r.last)]) for r in rows}


def _subtrees(leaves: DataFrame, arity: int, height: int) -> DataFrame:
    """The sorted leaves' complete aligned subtrees, a row for each, with its leaves."""
    sent = leaves.sparkSession.sparkContext.broadcast(_offsets(leaves))
    size = arity**height
    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.binary())]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last_total = sent.value.get(TaskContext.get().partitionId(), (0, 0))
        group, at = None, before
        held: tuple[list, list, list] = ([], [], [])

        def cut(total: int) -> Iterator[pa.RecordBatch]:
            """The subtrees of what is held, which ends at `at`. Where that is a block's end, any total from there on gives the same ones."""
            start = at - len(held[0])
            rows = []
            for level, idx, a, b in tiles(start, at, total, arity, height):
                own = [h[a - start : b - start] for h in held]
                rows.append((group, level, idx, levels_of(own[1], level, arity)[-1][0], *own))
            for h in held:
                h.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["grp", "level", "idx", "node", "keys", "leaves", "others"])

        for b in batches:
            done = 0
            for g, n in _runs(b.column(0)):
                if g != group:
                    yield from cut(at)
                    at, group = 0 if group is not None else before, g
                while n:
                    take = min(n, size - at % size)
                    for h, c in zip(held, b.columns[1:]):
                        h.extend(c.slice(done, take).to_pylist())
                    at, done, n = at + take, done + take, n - take
                    if at % size == 0:
                        yield from cut(at)
        yield from cut(last_total)

    return stored(leaves.select("grp", "key", "leaf", "other").mapInArrow(build, _TILE), "subtrees")


def _round(nodes: DataFrame, upto: int, arity: int) -> DataFrame:
    """Nodes below level `upto` (in lower trees, below the root), grouped by the node above them there: each one with the
    siblings on the way (path) and that node's place, and that node, without them."""
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
    names = ["grp", "total", "level", "idx", "node", "path", "up_level", "up_idx"]

    def climb(group: pa.Table) -> pa.Table:
        grp, total, up_level, up_idx = (group[c][0].as_py() for c in ("grp", "total", "up_level", "up_idx"))
        own = list(zip(group["level"].to_pylist(), group["idx"].to_pylist(), group["node"].to_pylist()))
        known: dict[int, dict[int, bytes]] = {k: {} for k in range(up_level + 1)}
        for level, idx, node in own:
            known[level][idx] = node
        for level in range(min(k for k, _, _ in own), up_level):
            runs: dict[int, list[bytes]] = {}
            for idx in sorted(known[level]):
                runs.setdefault(idx // arity, []).append(known[level][idx])
            known[level + 1] |= {idx: node_hash(run) for idx, run in runs.items()}
        rows = [(grp, total, up_level, up_idx, known[up_level][up_idx], None, None, None)]
        for level, idx, node in own:
            path, i = [], idx
            for k in range(level, up_level):
                first = i - i % arity
                path += [known[k][j] for j in range(first, min(first + arity, width(k, total, arity))) if j != i]
                i //= arity
            rows.append((grp, total, level, idx, None, b"".join(path), up_level, up_idx))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    below = nodes.where(F.col("level") < F.least(F.lit(upto), "height"))
    up = below.withColumn("up_level", F.least(F.lit(upto), "height")).withColumn("up_idx", F.floor(F.col("idx") / F.pow(F.lit(float(arity)), F.col("up_level") - F.col("level"))))
    return up.select("grp", "total", "level", "idx", "node", "up_level", "up_idx").groupBy("grp", "up_level", "up_idx").applyInArrow(climb, _ROUND)


def forest(leaves: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """leaves(grp binary, ord, leaf binary, key string, other binary, name) -> subtrees and groups.

    Subtrees(grp, total, level, idx, node, keys, leaves, others, path): path is the siblings of `node` up to its group's
    root, 32 bytes each. Groups(grp, name, total, root). Leaves ascend by ord (null first), then by leaf.
    """
    ordered = _sorted_leaves(leaves)
    trees = _subtrees(ordered, arity, height)
    sizes = stored(trees.groupBy("grp").agg(F.sum(F.size("leaves")).alias("total")), "sizes")
    tall = tree_height(sizes.agg(F.max("total")).first()[0] or 0, arity)
    # a whole number's logarithm is not exact, so heights are found by comparing with powers
    powers = F.array(*[F.lit(arity**k) for k in range(tall + 1)])
    sizes = sizes.withColumn("height", F.size(F.filter(powers, lambda p: p < F.col("total"))))
    nodes = trees.select("grp", "level", "idx", "node").join(sizes, "grp").select("grp", "total", "height", "level", "idx", "node")
    rounds = []
    for upto in range(height, tall + height, height):
        found = stored(_round(nodes, upto, arity), "round")
        rounds.append(found.where("path is not null").select(*_NODE, "path", "up_level", "up_idx"))
        made = found.where("path is null").join(sizes.select("grp", "height"), "grp").select("grp", "total", "height", "level", "idx", "node")
        nodes = stored(nodes.where(F.col("level") >= F.least(F.lit(upto), "height")).unionByName(made), "nodes")
    paths = None
    for r in reversed(rounds):
        if paths is None:
            paths = r.select(*_NODE, "path")
        else:
            above = paths.select("grp", F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), F.col("path").alias("more"))
            longer = r.join(above, ["grp", "up_level", "up_idx"], "left").select(*_NODE, F.concat("path", F.coalesce("more", F.lit(b""))).alias("path"))
            paths = longer.unionByName(paths)
    names = ordered.groupBy("grp").agg(F.first("name").alias("name"))
    groups = stored(nodes.select("grp", "total", F.col("node").alias("root")).join(names, "grp"), "groups")
    trees = trees.join(groups.select("grp", "total"), "grp")
    trees = trees.join(paths, _NODE, "left") if paths is not None else trees.withColumn("path", F.lit(None).cast("binary"))
    return trees.withColumn("path", F.coalesce("path", F.lit(b""))), groups


def _unfolded(trees: DataFrame, arity: int) -> DataFrame:
    """A row for each leaf: (key, leaf, other, idx, path, ...) and the columns of the subtree's row from the seventh on."""
    more = trees.columns[7:]

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                level, idx, path, keys, own, others, _ = (c[k].as_py() for c in b.columns[:7])
                nodes = levels_of(own, level, arity)
                start = idx * arity**level
                paths = [siblings(nodes, i, arity) + path for i in range(len(own))]
                made = [pa.array(keys, pa.string()), pa.array(own, pa.binary()), pa.array(others, pa.binary()), pa.array(range(start, start + len(own)), pa.int64()), pa.array(paths, pa.binary())]
                same = [c.take(pa.array([k] * len(own), pa.int32())) for c in b.columns[7:]]
                yield pa.RecordBatch.from_arrays([*made, *same], ["key", "leaf", "other", "idx", "path", *more])

    schema = ", ".join([_PROOF, *(f"{c} {dict(trees.dtypes)[c]}" for c in more)])
    return trees.mapInArrow(leaves, schema)


def proofs(rows: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", changed: tuple[Column, dict[str, Column]] | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """(key string, leaf, other, idx, path, total, subroot, group_idx, groups, group_path, root), a row for each input row.

    A leaf is the hash of the named fields. Leaves of one group ascend by the key (null first), rows of one key by
    their leaves; groups ascend by name, null first. `path` and `group_path` are the siblings from the leaf to its
    group's root and from there to the root, 32 bytes each, left to right, level by level: those of a run of `arity`
    nodes, fewer at a level's end, none beside a lone node. `other`, if changed=(where, {field: value}) is given, is
    the leaf of the changed fields where that holds, else null. Null fields and empty texts have their own hashes;
    repeated rows are leaves each; further columns are ignored; an empty table gives no row.
    """
    if arity < 2 or height < 1:
        raise ValueError("arity must be at least 2, height at least 1")
    bounded_batches(rows.sparkSession)
    other = F.lit(None).cast("binary")
    if changed is not None:
        where, values = changed
        other = F.when(where, leaf_hash([values.get(f, col(f)) for f in fields]))
    leaves = rows.select(F.unhex(F.sha2(field(col(group)), 256)).alias("grp"), col(key).alias("ord"), leaf_hash([col(f) for f in fields]).alias("leaf"), col(key).cast("string").alias("key"), other.alias("other"), col(group).cast("string").alias("name"))
    trees, groups = forest(leaves, arity, height)
    tops = groups.select(F.lit(b"").alias("grp"), F.col("name").alias("ord"), F.col("root").alias("leaf"), F.hex("grp").alias("key"), F.lit(None).cast("binary").alias("other"), F.lit(None).cast("string").alias("name"))
    upper, whole = forest(tops, arity, height)
    order = ["level", "idx", "path", "keys", "leaves", "others", "grp", "total"]
    named = _unfolded(upper.select(*order), arity).select(F.unhex("key").alias("grp"), F.col("leaf").alias("subroot"), F.col("idx").alias("group_idx"), F.col("total").alias("groups"), F.col("path").alias("group_path"))
    named = stored(named.crossJoin(F.broadcast(whole.select("root"))), "group-proofs")
    return _unfolded(trees.select(*order).join(named, "grp").select(*order, "subroot", "group_idx", "groups", "group_path", "root"), arity)


def verified(found: DataFrame, arity: int = ARITY) -> DataFrame:
    """proofs() with `folded`, the root that the leaf (the changed one where there is one) and its siblings give."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            above: dict[tuple, bytes] = {}
            out = []
            for leaf, other, idx, total, path, i, n, more in zip(*(c[x] for x in ("leaf", "other", "idx", "total", "path", "group_idx", "groups", "group_path"))):
                low = fold(leaf if other is None else other, idx, total, path, arity)
                if (low, i, more) not in above:
                    above[low, i, more] = fold(low, i, n, more, arity)
                out.append(above[low, i, more])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "folded"])

    return found.mapInArrow(check, ", ".join(f"{n} {t}" for n, t in [*found.dtypes, ("folded", "binary")]))


def manifest(docs: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """documents -> (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), hashes as lower-case hexadecimal text.

    Rows whose id's CRC-32 seven divides are folded with 1 added to n_chars. See proofs() for the order and for odd input.
    """
    where = F.crc32(F.encode(F.col("doc_id").cast("bigint").cast("string"), "UTF-8")) % 7 == 0
    found = verified(proofs(docs, changed=(where, {"n_chars": F.col("n_chars").cast("bigint") + 1}), arity=arity, height=height), arity)
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("key").cast("bigint").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text(F.concat("path", "group_path")).cast("binary"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


def _fields(n_chars: str) -> str:
    names = [n_chars if f == "n_chars" else f for f in FIELDS]
    return " || ".join(f"coalesce(strlen(({n})::VARCHAR)::VARCHAR || ':' || ({n})::VARCHAR, '-')" for n in names)


ORACLE = f"""WITH RECURSIVE base AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS g, sha256({_fields("n_chars")}) AS leaf, sha256({_fields("n_chars + 1")}) AS other, doc_id::VARCHAR AS k FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n, CASE WHEN {_CRC} % 7 = 0 THEN other ELSE leaf END AS told FROM base),
tree AS (SELECT g, 0 AS lvl, idx, n, leaf AS h FROM l UNION ALL
 SELECT g, lvl + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY g, lvl, idx // 2),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS lvl, idx, n, h FROM sub UNION ALL
 SELECT lvl + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 2),
climb AS (SELECT g, l.idx AS row, doc_id, leaf, idx, n, 0 AS lvl, '' AS path, told AS h FROM l UNION ALL
 SELECT c.g, c.row, c.doc_id, c.leaf, c.idx // 2, (c.n + 1) // 2, c.lvl + 1, c.path || coalesce(t.h, ''), sha256(CASE WHEN c.idx % 2 = 0 THEN c.h || coalesce(t.h, '') ELSE t.h || c.h END)
 FROM climb c LEFT JOIN tree t ON t.g = c.g AND t.lvl = c.lvl AND t.idx = xor(c.idx, 1) WHERE c.n > 1),
up AS (SELECT c.g, c.row, c.doc_id, c.leaf, s.h AS subroot, s.idx, s.n, 0 AS lvl, c.path, c.h FROM climb c JOIN sub s USING (g) WHERE c.n = 1 UNION ALL
 SELECT c.g, c.row, c.doc_id, c.leaf, c.subroot, c.idx // 2, (c.n + 1) // 2, c.lvl + 1, c.path || coalesce(t.h, ''), sha256(CASE WHEN c.idx % 2 = 0 THEN c.h || coalesce(t.h, '') ELSE t.h || c.h END)
 FROM up c LEFT JOIN top t ON t.lvl = c.lvl AND t.idx = xor(c.idx, 1) WHERE c.n > 1)
SELECT u.doc_id, u.leaf, u.subroot, t.h AS root, sha256(u.path) AS proof_sha256, u.h AS folded_root, u.h = t.h AS verified FROM up u, top t WHERE u.n = 1 AND t.n = 1"""
