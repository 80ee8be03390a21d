"""Every registered query against its SQL on the smallest tables, and plan checks on all of them."""

import glob
import math
import os

import duckdb
import pytest
from helpers import plan

import __spark_entry__ as entry_points
from evidrank.plans import registry
from evidrank.plans.table_scored import LAYERS, composite_documents

# The library's own queries; those of the llm subpackage have their tests beside them.
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE


@pytest.fixture(scope="module")
def oracle(tables):
    con = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def clean(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return v

    out = [tuple(clean(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, tables, oracle, name):
    df = QUERIES[name](spark, tables)
    text = plan(df)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    cursor = oracle.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got, want = canonical(df.columns, [tuple(r) for r in df.collect()]), canonical(names, cursor.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(v, float) for v in a) else list(map(str, a)) == list(map(str, b))


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and {"composite_score", "confidence_tier", "supporting_layers"} <= set(df.columns)


def test_scores_stay_in_range_and_contributions_add_up(spark, tables):
    from pyspark.sql import functions as F

    df = composite_documents(spark, tables).cache()
    for c in ["composite_score", *[f"{n}_score" for n in LAYERS]]:
        assert df.where((F.col(c) < 0) | (F.col(c) > 1)).count() == 0
    assert df.where(F.col("composite_score").isNull() != (F.col("evidence_count") == 0)).count() == 0


def test_scans_read_only_what_they_need(spark, tables):
    text = plan(QUERIES["quality_flag"](spark, tables))
    scan = next(line for line in text.splitlines() if "lineitem.parquet" in line)
    assert "l_partkey" in scan and "l_linestatus" in scan and "l_quantity" not in scan and "l_shipdate" not in scan
    text = plan(QUERIES["tau_specificity"](spark, tables))
    assert "PushedFilters: []" in text and "GreaterThan" not in text and "props" not in text  # every event is read


def test_entry_points_hold_every_query():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_one_scan_of_the_line_items(spark, tables):
    from evidrank.plans.table_layers import supplied_parts

    text = plan(supplied_parts(spark, tables))
    assert text.count("lineitem.parquet") == 1 and "PushedFilters: []" in text
