import os

import pytest

import __spark_entry__
import corpus_pipeline


def test_stages_keep_columns_and_clean_documents(spark, small):
    if not os.path.isdir(small):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, small).cache()
        assert after.columns == columns, name
        assert after.select("doc_id").distinct().count() > 0.5 * seen.select("doc_id").distinct().count(), name
        seen = after
    assert corpus_pipeline.STAGES[-1][1](spark, seen, small).count() == seen.count()


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 13))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
