"""Updates of part of a table, seen in its files."""

import os

import pytest

from sparkwright.sources.buckets import Buckets

SCHEMA = "file string, line int, text string"


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_an_update_rewrites_its_bucket_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = Buckets(spark, path, SCHEMA, ["file"], 16)
    assert table.read().count() == 0
    want = [(f"f{i % 40}", i, f"t{i}") for i in range(400)] + [(None, 1, "none"), (None, 2, "none")]
    table.overwrite(spark.createDataFrame(want, SCHEMA))
    assert rows_of(table.read()) == sorted(want, key=str)
    before = files_of(path)
    touched = table.replace(spark.createDataFrame([("f7",)], "file string"), spark.createDataFrame([("f7", 0, "new"), ("f7", 1, None)], SCHEMA))
    want = [r for r in want if r[0] != "f7"] + [("f7", 0, "new"), ("f7", 1, None)]
    assert rows_of(table.read()) == sorted(want, key=str) and len(touched) == 1
    after = files_of(path)
    changed = {os.path.basename(os.path.dirname(f)) for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {f"bucket={touched[0]}"}
    # again the same: the same rows
    table.replace(spark.createDataFrame([("f7",)], "file string"), spark.createDataFrame([("f7", 0, "new"), ("f7", 1, None)], SCHEMA))
    assert rows_of(table.read()) == sorted(want, key=str)
    assert rows_of(table.lookup(spark.createDataFrame([("f7",), (None,), ("absent",)], "file string"))) == sorted([r for r in want if r[0] in ("f7", None)], key=str)
    plan = table.lookup(spark.createDataFrame([("f7",)], "file string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:40]


def test_deletes_and_upserts(spark, tmp_path):
    table = Buckets(spark, f"{tmp_path}/t", SCHEMA, ["file", "line"], 4)
    table.upsert(spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", None, "z")], SCHEMA))
    assert rows_of(table.read()) == [("a", 1, "y"), ("b", None, "z")]
    table.upsert(spark.createDataFrame([("b", None, None), ("c", 3, "new")], SCHEMA))
    assert rows_of(table.read()) == [("a", 1, "y"), ("b", None, None), ("c", 3, "new")]
    table.delete(table.read().select("file", "line"))
    assert rows_of(table.read()) == [] and table.delete(table.read().select("file", "line")) == []
    table.upsert(spark.createDataFrame([("a", 2, "back")], SCHEMA))
    assert rows_of(table.read()) == [("a", 2, "back")]
    with pytest.raises(ValueError):
        Buckets(spark, str(tmp_path), "bucket int", ["bucket"])
