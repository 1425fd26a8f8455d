"""Every query with SQL against DuckDB over the small tables."""

import math

import duckdb
import pytest

from caseflow.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, name):
    base = duckdb.connect()
    for table in ("documents", "labels", "conversations", "embeddings"):
        base.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    want = base.sql(SQL[name])
    names = sorted(want.columns)
    found = QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == names
    a = sorted(found.select(*names).toPandas().itertuples(index=False, name=None))
    b = sorted(want.df()[names].itertuples(index=False, name=None))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and math.isclose(p, q, rel_tol=1e-12)) for p, q in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_one_row_per_document(spark, name):
    found = QUERIES[name](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert found.select("doc_id").distinct().count() == docs.count()
    if name != "op1_packing":
        assert found.count() == docs.count()
