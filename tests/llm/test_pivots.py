import numpy as np
import pytest
from llm_data import plain
from pyspark.sql import functions as F

from evidrank.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(made, is_query, k=20):
    rows = [(i, np.floor(np.array(v, np.float32).astype(float) * 64)) for i, v, _ in made if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in rows), default=0)
    rows = {i: np.pad(v, (0, width - len(v))).astype(np.int64) for i, v in rows}
    out = []
    for q in (i for i in rows if is_query(i)):
        best = sorted((-int(rows[q] @ v), i) for i, v in rows.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out, key=str)


def vectors(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    made = [(k, (centres[k % 6] * (1 + k % 3) + 0.4 * rng.normal(size=dim)).astype(np.float32).tolist(), 0) for k in range(n)]
    return made + [(10_000 + k, made[3][1], 0) for k in range(copies)]


SMALL = pivots.Search(pivots=5, block=16, chunk=4)


@pytest.mark.parametrize("made", [vectors(300, 8, 1), vectors(150, 3, 2, copies=120), vectors(7, 2, 3)])
@pytest.mark.parametrize("search", [SMALL, pivots.Search()])
def test_results_are_exact(spark, made, search):
    got = pivots.top_k(spark.createDataFrame(made, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, search)
    assert plain(got) == brute(made, lambda i: i % 20 == 0)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    made = [(0, [1.0, -2.5], 0), (20, [0.0, 0.0], 0), (40, [], 0), (60, None, 0), (80, [nan, 1.0], 0), (100, [None, 1.0], 0), (120, [inf], 0)]
    made += [(None, [1.0, 1.0], 0), (1, [1e6, -1e6], 0), (2, [-3e8, 3e8, 5.0], 0), (3, [0.001, -0.001], 0), (4, [1.0, -2.5], 0)]
    got = pivots.top_k(spark.createDataFrame(made, SCHEMA), F.col("vec_id") % 20 == 0, SMALL)
    assert plain(got) == brute(made, lambda i: i % 20 == 0)


def test_far_annuli_are_left_out(spark):
    """Close clusters: the radius reaches few annuli."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 4)) * 20
    centres *= 40 / np.linalg.norm(centres, axis=1)[:, None]
    made = [(k, (centres[k % 20] + 0.01 * rng.normal(size=4)).tolist(), 0) for k in range(2000)]
    search = pivots.Search(k=5, pivots=20, block=50, chunk=8)
    got = pivots.top_k(spark.createDataFrame(made, SCHEMA), F.col("vec_id") % 40 == 0, search)
    assert plain(got) == brute(made, lambda i: i % 40 == 0, 5)


def test_repeated_ids_clashing_columns_and_empty_tables(spark):
    made = vectors(60, 3, 5)
    df = spark.createDataFrame([*made, *made[:5]], SCHEMA)
    clash = df.select("*", *[F.lit("x").alias(n) for n in ("key", "length2", "pivot", "ids", "score", "query_id")])
    assert plain(pivots.top_k(clash, F.col("vec_id") % 20 == 0, SMALL)) == brute(made, lambda i: i % 20 == 0)
    assert pivots.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert pivots.top_k(df, F.col("vec_id") == -1).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    """Few different components, so that most products are tied, also between annuli."""
    rng = np.random.default_rng(11)
    made = [(int(k), (rng.integers(-2, 3, 6) / 64).tolist(), 0) for k in rng.permutation(400)]
    got = pivots.top_k(spark.createDataFrame(made, SCHEMA), F.col("vec_id") % 20 == 0, SMALL)
    assert plain(got) == brute(made, lambda i: i % 20 == 0)


def test_annuli_are_read_once_for_a_group_and_low_products_stay_in_the_task(spark):
    rng = np.random.default_rng(12)
    x, q = rng.integers(-30, 30, (5, 40, 4)), rng.integers(-30, 30, (3, 4))
    key = lambda rows: [row.astype("<i8").tobytes() for row in rows]
    blocks = [(b, key(x[b]), [[100 * b + i, 1000 + 100 * b + i] for i in range(40)]) for b in range(5)]
    scores = np.sort((q @ x.reshape(-1, 4).T), axis=1)[:, ::-1]
    known = [(0, int(scores[0, 3])), (2, int(scores[2, 0]) + 1)]
    chunks = spark.createDataFrame([(7, key(q), known)], "chunk long, keys array<binary>, known array<struct<at:int,score:long>>")
    blocks = spark.createDataFrame(blocks, "block long, keys array<binary>, ids array<array<long>>")
    found = pivots._meet(chunks.select("chunk").crossJoin(blocks.select("block")), chunks, blocks, 4, pivots.Search(k=6))
    rows = found.collect()
    for at, least, most in ((0, scores[0, 3], 7), (1, -(2**63), 7), (2, scores[2, 0] + 1, 7)):
        best = sorted((-int(q[at] @ x[b, i]), 100 * b + i) for b in range(5) for i in range(40))[:most]
        want = [(-s, i + more) for s, i in best if -s >= least for more in (0, 1000)]
        assert sorted((r.score, r.vec_id) for r in rows if r["at"] == at) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")
