"""Queries that SQL can express, against that SQL over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from evidrank.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_agrees_with_sql(spark, tables, name):
    con = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    clean = lambda v: "None" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.3f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(clean(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(clean(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_returns_every_document(spark, tables, name):
    got = queries.QUERIES[name](spark, tables).select("doc_id").distinct().count()
    assert got == spark.read.parquet(f"{tables}/documents.parquet").select("doc_id").distinct().count()
