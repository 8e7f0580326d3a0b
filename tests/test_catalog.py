"""Each query of the catalogue against its DuckDB statement, by sorted rows."""

import os

import duckdb
import pytest

from sparkwright.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else "" if v is None else str(v)


@pytest.fixture(scope="module")
def duck(small):
    if not os.path.isdir(small):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalog.ORACLES:
        assert name in ("keyword_stemmed_topk", "hnsw_topk")
        return
    cursor = duck.execute(catalog.ORACLES[name])
    found = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(found) == columns
    assert {c: KINDS[k] for c, k in df.dtypes} == found
    places = [list(found).index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in cursor.fetchall())
