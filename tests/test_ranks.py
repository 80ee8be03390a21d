"""Rank helpers against Spark's own window functions and exact percentiles."""

import random

import pytest
from helpers import by_key, plan, rows
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidrank.functions import ranks as R


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows hold one value, a tenth hold none, the rest repeat now and then."""
    n = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 10 == 0, None)
        .when(F.col("id") % 3 == 0, 0.5)
        .otherwise((F.col("id") * 7919 % 1009).cast("double"))
        .alias("v"),
        (F.col("id") % 3).alias("g"),
    )
    return n.cache()


def known(df):
    return df.where(F.col("v").isNotNull())


def test_percentile_by_count(skewed):
    got = by_key(R.with_percentile(skewed, {"p": "v"}), "id", "p")
    w = W.orderBy("v")
    ties = F.count("v").over(W.partitionBy("v"))
    expected = known(skewed).withColumn("p", (F.rank().over(w) + (ties - 1) / 2) / F.count("v").over(W.partitionBy()))
    want = by_key(expected, "id", "p")
    assert len(got) == 3000
    assert {k for k, v in got.items() if v is None} == set(range(0, 3000, 10))
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_percentile_by_max_rank_reaches_one(skewed):
    got = R.with_percentile(skewed, {"p": "v"}, over="max").agg(F.max("p"), F.min("p")).first()
    assert got[0] == 1.0 and got[1] > 0


def test_percent_rank(skewed):
    got = by_key(R.with_percent_rank(skewed, "v"), "id", "percentile_rank")
    want = by_key(known(skewed).withColumn("p", F.percent_rank().over(W.orderBy("v"))), "id", "p")
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert got[0] is None


def test_percent_rank_of_a_single_row(spark):
    one = spark.createDataFrame([(1, 5.0)], "id int, v double")
    assert R.with_percent_rank(one, "v").first()["percentile_rank"] == 0.0


def test_quantiles_by_group(skewed):
    marks = {"a": 0.1, "b": 0.5, "c": 0.77, "d": 1.0}
    got = {r["g"]: [r[m] for m in marks] for r in R.quantiles(skewed, "v", marks, by=["g"]).collect()}
    exact = skewed.groupBy("g").agg(F.percentile("v", list(marks.values())).alias("q")).collect()
    for row in exact:
        assert got[row["g"]] == pytest.approx(row["q"], abs=1e-9)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert R.quantiles(empty, "v", {"m": 0.5}).first()["m"] is None


def test_row_number_breaks_ties_by_id(skewed):
    order = [F.desc_nulls_last("v"), F.asc("id")]
    got = by_key(R.with_row_number(skewed, order), "id", "position")
    want = by_key(skewed.withColumn("n", F.row_number().over(W.orderBy(*order))), "id", "n")
    assert got == want


def test_hot_values_are_seen_and_salted(skewed):
    bounds = R.measure_bounds(skewed, {"v": "v"})["v"]
    assert 0.5 in bounds.hot
    table = R.value_table(skewed, "v", bounds)
    attached = R.attach_table(skewed, table, "v", bounds)
    assert "explode" in plan(attached)
    assert attached.count() == 3000
    assert attached.where("v = 0.5").select("n_ties").distinct().count() == 1


@pytest.mark.parametrize("k", [0, 1, 2, 7, 100])
def test_bucket_counts_the_edges_below(spark, k):
    edges = tuple(float(i) for i in range(k))
    bounds = R.Bounds(edges, ())
    got = spark.range(-1, k + 2).select("id", bounds.bucket(F.col("id").cast("double")).alias("b")).collect()
    assert all(r["b"] == sum(e < r["id"] for e in edges) for r in got)


def test_no_single_task_over_rows(skewed):
    """The only gather is over per-bucket totals, which are aggregated twice before."""
    text = plan(R.with_percentile(skewed, {"p": "v"}))
    for line_no, line in enumerate(lines := text.splitlines()):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate(keys=[_bucket" in lines[line_no + 1]


def test_positions_of_probes_with_hot_ties_and_repeated_rows(spark):
    pick = random.Random(7)
    data = [(f"g{pick.randrange(400):03d}", pick.choice([0.0, 0.0, 0.0, 0.5, pick.random(), None, float("nan")])) for _ in range(2000)]
    known = [(v, k) for k, v in data if v is not None and v == v]
    probes = sorted({known[pick.randrange(len(known))] for _ in range(60)} | {(v, k) for v, k in known if v == 0.0 and k < "g050"})
    df = spark.createDataFrame(data, "id string, v double").repartition(5)
    asked = spark.createDataFrame([(k, v) for v, k in probes], "id string, v double")
    got = {(r["v"], r["id"]): r["position"] for r in R.probe_positions(df, asked, "v", "id").collect()}
    assert got == {(v, k): 1 + sum(w > v or (w == v and j < k) for w, j in known) for v, k in probes}
    assert R.probe_positions(df, asked.limit(0), "v", "id").count() == 0


def test_recall_neither_sorts_nor_numbers_the_scored_rows(spark):
    from evidrank.operators.controls import recall_at_k

    scored = spark.createDataFrame([(f"g{k:03d}", k % 7 / 7) for k in range(300)], "gene_symbol string, composite_score double")
    controls = spark.createDataFrame([("g006",), ("g299",), ("nobody",)], "gene_symbol string")
    df = recall_at_k(scored, controls, ks=(5, 43), fractions=(0.5,))
    assert "rangepartitioning" not in plan(df)
    assert rows(df, "threshold", "hits", "total_known") == [("43", 1, 3), ("5", 1, 3), ("50%", 2, 3)]  # g006 is first, g299 comes 85th
