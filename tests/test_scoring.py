"""Composite, report, quality, controls, sweep and a whole run."""

import pytest
from helpers import by_key, one, plan, rows
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidrank.operators import composite as J
from evidrank.operators import controls as K
from evidrank.operators import entities as E
from evidrank.operators import quality as Q
from evidrank.operators import report as P
from evidrank.operators import sweep as S
from evidrank.plans import presets
from evidrank.plans.evidence_run import EvidenceRun
from evidrank.sources.stages import StageStore

LAYERS = list(J.DEFAULT_WEIGHTS)


def store_frames(spark):
    universe = spark.createDataFrame(
        [("g1", "A"), ("g2", "B"), ("g3", "C"), ("g4", "C"), ("g5", None), ("g6", None)], "gene_id string, gene_symbol string"
    )
    frame = lambda *r: (spark.createDataFrame(list(r), "gene_id string, s double"), "s")
    layers = {
        "gnomad": frame(("g1", 0.8), ("g1", 0.9), ("g2", 0.5), ("g9", 1.0)),
        "expression": frame(("g1", 0.7), ("g3", 0.1)),
        "annotation": frame(("g3", 0.2), ("g4", 1.0)),
        "localization": frame(("g1", None)),
        "animal_model": frame(("g5", 0.3)),
        "literature": frame(),
    }
    return universe, layers


def test_join_keeps_missing_apart_from_zero(spark):
    out = J.evidence_join(*store_frames(spark), dedupe=False)
    assert rows(out, "gene_id", "gnomad_score", "localization_score", "evidence_count") == [
        ("g1", 0.9, None, 2),
        ("g2", 0.5, None, 1),
        ("g3", None, None, 2),
        ("g4", None, None, 1),
        ("g5", None, None, 1),
        ("g6", None, None, 0),
    ]


def test_ids_that_are_missing_meet_nothing(spark):
    universe = spark.createDataFrame([(None, "X"), ("g1", "Y")], "gene_id string, gene_symbol string")
    layer = spark.createDataFrame([(None, 0.9), ("g1", 0.4)], "gene_id string, score double")
    out = J.evidence_join(universe, {"a": (layer, "score")}, dedupe=False)
    assert by_key(out, "gene_symbol", "a_score") == {"X": None, "Y": 0.4}


def test_join_is_one_shuffle(spark):
    text = plan(J.evidence_join(*store_frames(spark), dedupe=False))
    assert text.split("Initial Plan")[-1].count("Exchange") == 1 and "Join" not in text


def test_composite(spark):
    out = J.weighted_composite(J.evidence_join(*store_frames(spark), dedupe=False))
    got = by_key(out, "gene_id", "composite_score")
    assert set(got) == {"g1", "g2", "g3", "g5", "g6"}, "C keeps its row with more layers; rows without symbol stay"
    assert got["g1"] == pytest.approx((0.9 * 0.2 + 0.7 * 0.2) / 0.4)
    assert got["g2"] == pytest.approx(0.5) and got["g6"] is None
    assert by_key(out, "gene_id", "quality_flag") == {
        "g1": "moderate_evidence",
        "g2": "sparse_evidence",
        "g3": "moderate_evidence",
        "g5": "sparse_evidence",
        "g6": "no_evidence",
    }
    parts = [F.coalesce(f"{n}_contribution", F.lit(0.0)) for n in LAYERS]
    assert out.where(F.abs(sum(parts, F.lit(0.0)) - F.col("weighted_sum")) > 1e-12).count() == 0
    order = [r["gene_id"] for r in J.by_score(out).collect()]
    assert order[0] == "g1" and order[-1] == "g6"


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.4}, {"a": 1.2, "b": -0.2}])
def test_bad_weights(weights):
    with pytest.raises(ValueError):
        J.check_weights(weights)


def test_dedup_limits_before_the_shuffle(spark):
    out = J.best_per_symbol(spark.createDataFrame([("g", "s", 1.0)], "gene_id string, gene_symbol string, x double"), [F.desc("x")])
    text = plan(out).split("Initial Plan")[-1]
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def scored(spark):
    data = [("g1", 0.85, 5), ("g2", 0.72, 2), ("g3", 0.7, 3), ("g4", 0.4, 2), ("g5", 0.39, 6), ("g6", 0.2, 1), ("g7", 0.19, 6), ("g8", None, 0)]
    return spark.createDataFrame(data, "gene_id string, composite_score double, evidence_count long")


def test_tiers(spark):
    assert by_key(P.assign_tiers(scored(spark)), "gene_id", "confidence_tier") == {
        "g1": "HIGH",
        "g2": "MEDIUM",
        "g3": "HIGH",
        "g4": "MEDIUM",
        "g5": "LOW",
        "g6": "LOW",
    }
    custom = {"TOP": {"composite_score": 0.8, "evidence_count": 1}}
    assert by_key(P.assign_tiers(scored(spark), custom), "gene_id", "confidence_tier") == {"g1": "TOP"}


def test_category_counts_and_histogram(spark):
    tiered = P.assign_tiers(scored(spark))
    assert by_key(P.category_counts(tiered, "confidence_tier"), "confidence_tier", "n") == {"HIGH": 2, "MEDIUM": 2, "LOW": 2}
    bins = P.score_histogram(tiered, 2)
    assert rows(bins, "bin", "confidence_tier", "n") == [(0, "LOW", 2), (0, "MEDIUM", 1), (1, "HIGH", 2), (1, "MEDIUM", 1)]
    flat = P.score_histogram(tiered.where("gene_id = 'g1'"))
    assert rows(flat, "bin", "n") == [(0, 1)]


def test_dual_sink(spark, tmp_path):
    df = P.assign_tiers(scored(spark)).withColumn("tags", F.array(F.lit("a")))
    stats = one(P.write_dual(df, str(tmp_path)))
    assert stats == {"total_candidates": 6, "high_count": 2, "medium_count": 2, "low_count": 2, "column_count": 5}
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "candidates.tsv"))
    assert back.columns == df.columns and [r["gene_id"] for r in back.collect()] == ["g1", "g2", "g3", "g4", "g5", "g6"]
    assert spark.read.parquet(str(tmp_path / "candidates.parquet")).count() == 6


def quality_table(spark):
    n = spark.range(200)
    return n.select(
        F.col("id").cast("string").alias("gene_symbol"),
        (F.col("id") / 200).alias("a_score"),
        F.when(F.col("id") < 10, 0.5).alias("b_score"),
        F.when(F.col("id") % 5 < 2, 1.5).alias("c_score"),
        F.lit(None).cast("double").alias("d_score"),
        F.when(F.col("id") > 190, 1.0).otherwise(F.col("id") % 7 / 100).alias("e_score"),
        (F.col("id") / 200).alias("composite_score"),
    )


def test_quality(spark):
    df, names = quality_table(spark).cache(), list("abcde")
    assert by_key(Q.missing_rates(df, names), "layer", "severity") == {"a": "ok", "b": "error", "c": "warning", "d": "error", "e": "ok"}
    stats = {r["layer"]: r.asDict() for r in Q.distribution_stats(df, names).collect()}
    assert stats["a"]["median"] == pytest.approx(0.4975) and stats["a"]["severity"] == "ok"
    assert stats["c"]["severity"] == "error" and stats["b"]["severity"] == "warning"
    assert stats["d"]["count"] == 0 and stats["d"]["median"] is None and stats["d"]["severity"] == "warning"
    found = {r["layer"]: (r["outlier_count"], r["examples"]) for r in Q.mad_outliers(df, names).collect()}
    assert found["e"] == (9, ["191", "192", "193", "194", "195"])
    assert all(found[k] == (0, None) for k in "abcd")
    findings = Q.qc_findings(df, names).cache()
    assert rows(findings, "check_name", "layer", "severity") == [
        ("distribution", "b", "warning"),
        ("distribution", "c", "error"),
        ("distribution", "c", "warning"),
        ("distribution", "d", "warning"),
        ("missing_data", "b", "error"),
        ("missing_data", "c", "warning"),
        ("missing_data", "d", "error"),
    ]
    assert findings.where("layer = 'b' and severity = 'error'").first()["message"] == "b: 95.0% missing"
    assert one(Q.qc_verdict(findings)) == {"warnings": 4, "errors": 3, "passed": False}
    row = one(Q.composite_stats(df))
    assert row["p25"] == pytest.approx(0.24875) and row["median"] == row["p50"] and row["total"] == 200


def ranked_table(spark):
    return spark.range(101).select(
        F.format_string("s%03d", F.col("id")).alias("gene_symbol"), (F.col("id") / 100).alias("composite_score")
    )


def test_controls(spark):
    table = ranked_table(spark)
    sets = K.control_set(spark, {"x": ["s100", "s090", "s080"], "y": ["s100", "s010", "absent"], "z": ["nowhere"]})
    assert sets.count() == 7
    ranked = K.rank_controls(table, sets)
    assert one(K.control_summary(ranked, sets)) == {
        "total_expected": 6,
        "total_in_dataset": 4,
        "median_percentile": pytest.approx(0.85),
        "top_quartile_count": 3,
        "top_quartile_fraction": 0.75,
        "high_score_count": 3,
        "validation_passed": True,
        "reason": None,
    }
    assert one(K.control_summary(ranked, sets, positive=False))["reason"] == "median_over_limit"
    assert rows(K.control_by_source(ranked, sets)) == [
        ("x", pytest.approx(0.9), 3, 3),
        ("y", pytest.approx(0.55), 2, 1),
        ("z", None, 0, 0),
    ]
    assert [r["gene_symbol"] for r in K.control_details(ranked, k=3).collect()] == ["s100", "s100", "s090"]
    assert [r["gene_symbol"] for r in K.control_details(ranked, best_first=False, k=1).collect()] == ["s010"]


def test_controls_without_a_match(spark):
    sets = K.control_set(spark, {"x": ["absent"]})
    row = one(K.control_summary(K.rank_controls(ranked_table(spark), sets), sets))
    assert row["total_in_dataset"] == 0 and row["validation_passed"] is False and row["reason"] == "no_controls_found"
    assert row["median_percentile"] is None and row["top_quartile_fraction"] == 0.0


def test_preset_controls(spark):
    sets = K.control_set(spark, presets.POSITIVE_CONTROLS)
    assert by_key(P.category_counts(sets, "source"), "source", "n") == {"omim_usher": 10, "syscilia_scgs_v2": 28}
    assert K.control_set(spark, presets.NEGATIVE_CONTROLS).count() == 13


def test_recall_with_hot_ties(spark):
    """Most rows share one score, so the cut falls inside the tie and only the id decides."""
    table = spark.range(1000).select(
        F.format_string("s%04d", F.col("id")).alias("gene_symbol"), F.when(F.col("id") < 10, 0.9).otherwise(0.5).alias("composite_score")
    )
    sets = spark.createDataFrame([("s0000",), ("s0099",), ("s0100",), ("s0900",), ("none",)], "gene_symbol string")
    got = {r["threshold"]: (r["k"], r["hits"], r["recall"]) for r in K.recall_at_k(table, sets, [5, 100, 2000], [0.1, 0.2]).collect()}
    assert got == {"5": (5, 1, 0.2), "100": (100, 2, 0.4), "2000": (2000, 4, 0.8), "10%": (100, 2, 0.4), "20%": (200, 3, 0.6)}


@pytest.mark.parametrize(
    "row, status",
    [
        ((True, True, True), "all_passed"),
        ((True, True, False), "sensitivity_unstable"),
        ((True, False, True), "specificity_issue"),
        ((False, True, True), "failed"),
        ((True, True, None), "sensitivity_not_run"),
    ],
)
def test_verdict(spark, row, status):
    df = spark.createDataFrame([row], "p boolean, n boolean, s boolean")
    assert df.select(K.verdict_of(F.col("p"), F.col("n"), F.col("s")).alias("v")).first()["v"] == status


def test_perturbed_weights_renormalise():
    moved = S.perturb_weights(J.DEFAULT_WEIGHTS, "gnomad", 0.1)
    assert sum(moved.values()) == pytest.approx(1.0) and moved["gnomad"] == pytest.approx(0.3 / 1.1)
    assert S.perturb_weights({"a": 1.0, "b": 0.0}, "a", -2.0) == {"a": 0.5, "b": 0.5}
    assert S.perturb_weights({"a": 0.95, "b": 0.05}, "a", 0.5)["a"] == pytest.approx(1 / 1.05)
    with pytest.raises(ValueError):
        S.perturb_weights({"a": 1.0}, "b", 0.1)


def test_weight_table_equals_weight_dicts(spark):
    base = spark.createDataFrame([tuple(J.DEFAULT_WEIGHTS.values())], ", ".join(f"{n} double" for n in J.DEFAULT_WEIGHTS))
    got = {(r["target_layer"], r["delta"], r["layer"]): r["weight"] for r in S.weight_scenarios(base).collect()}
    want = {(n, d, k): v for n, d, w in S.scenarios(J.DEFAULT_WEIGHTS) for k, v in w.items()}
    assert got == pytest.approx(want)


def sweep_input(spark):
    part = lambda i: F.when(F.col("id") % (i + 2) != 0, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000)
    df = spark.range(600).select(
        "id",
        F.col("id").alias("gene_id"),
        F.when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("id") / 3).cast("int"))).alias("gene_symbol"),
        *[part(i).alias(f"{n}_score") for i, n in enumerate(LAYERS)],
    )
    return df.withColumn("evidence_count", sum((F.col(f"{n}_score").isNotNull().cast("long") for n in LAYERS), F.lit(0)))


def test_sweep_equals_recomputation(spark):
    """The one-job sweep against one composite per scenario, ranked and correlated in pandas."""
    joined = sweep_input(spark).cache()
    swept = {(r["layer"], r["delta"]): r for r in S.sensitivity_sweep(joined, J.DEFAULT_WEIGHTS, [-0.1, 0.1], 50).collect()}

    def top(weights):
        ordered = J.weighted_composite(joined, weights).where("composite_score is not null")
        return ordered.orderBy(F.desc("composite_score"), "gene_id").limit(50).toPandas().dropna(subset=["gene_symbol"])

    base = top(J.DEFAULT_WEIGHTS)
    for layer, delta, weights in S.scenarios(J.DEFAULT_WEIGHTS, [-0.1, 0.1]):
        both = base.merge(top(weights), on="gene_symbol")
        rho = both["composite_score_x"].rank().corr(both["composite_score_y"].rank())
        assert swept[(layer, delta)]["overlap_count"] == len(both)
        assert swept[(layer, delta)]["spearman_rho"] == pytest.approx(rho, abs=1e-9)
    assert len(swept) == 12


def test_sweep_prunes_before_it_aggregates(spark):
    """Few symbols are left to aggregate, and the lists are those of all symbols, ties and repeated symbols included."""
    rows = spark.range(4000).select(
        F.col("id").alias("gene_id"),
        F.when(F.col("id") % 50 != 3, F.concat(F.lit("g"), (F.col("id") % 1500).cast("string"))).alias("gene_symbol"),
        *[F.when((F.col("id") + 3 * k) % 7 != 0, F.round(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000, 2)).alias(f"{n}_score") for k, n in enumerate(J.DEFAULT_WEIGHTS)],
    )
    rows = rows.withColumn("evidence_count", sum(F.col(f"{n}_score").isNotNull().cast("int") for n in J.DEFAULT_WEIGHTS)).cache()
    plans = [dict(J.DEFAULT_WEIGHTS), *[w for *_, w in S.scenarios(J.DEFAULT_WEIGHTS)]]
    bounds = S.entry_bounds(rows, plans, 100, digits=9)
    assert None not in bounds
    few = S.contenders(rows, plans, bounds, digits=9)
    assert few.count() < rows.count() / 3
    lists = lambda df: S._top(S.best_by_scenario(df, plans, digits=9), 100, "gene_id").drop("_n")
    whole = sorted(map(tuple, lists(rows).collect()), key=str)
    assert sorted(map(tuple, lists(few).collect()), key=str) == whole and len(whole) == 2500
    assert S.contenders(rows, plans, [None, *bounds[1:]]) is rows
    assert S.entry_bounds(rows.limit(50), plans, 100) == [None] * 25


def test_sweep_needs_ten_common_rows(spark):
    few = sweep_input(spark).where("id between 1 and 20")
    out = S.sensitivity_sweep(few, J.DEFAULT_WEIGHTS, [0.1])
    assert {r["spearman_rho"] for r in out.collect()} == {None}
    row = one(S.sweep_summary(out))
    assert row["overall_stable"] is False and row["most_sensitive_layer"] is None and row["total_perturbations"] == 6


def test_sweep_does_not_multiply_rows_before_the_shuffle(spark):
    text = plan(S.sensitivity_sweep(sweep_input(spark), J.DEFAULT_WEIGHTS)).split("Initial Plan")[-1]
    generate = text.index("Generate inline")
    assert text.index("partial_min", generate) > text.index("Exchange", generate), "partial best per scenario runs map-side"
    assert "Partial" in text[:generate], "top lists are limited map-side"
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_summary_picks_layers(spark):
    data = [("a", 0.1, 0.9), ("a", -0.1, 0.8), ("b", 0.1, 0.99), ("b", -0.1, None), ("c", 0.1, 0.95)]
    df = spark.createDataFrame(data, "layer string, delta double, spearman_rho double")
    row = one(S.sweep_summary(df))
    assert (row["most_sensitive_layer"], row["most_robust_layer"]) == ("a", "b")
    assert (row["stable_count"], row["unstable_count"], row["total_perturbations"], row["overall_stable"]) == (3, 1, 5, False)


def test_universe_gate(spark):
    ids = spark.createDataFrame([("ENSG1",), ("ENSG1",), ("X2",)], "gene_id string")
    assert one(E.universe_gate(ids, low=1, high=5)) == {
        "total": 3,
        "bad_prefix": 1,
        "duplicates": 1,
        "size_ok": True,
        "prefix_ok": False,
        "unique_ok": False,
        "passed": False,
    }
    assert one(E.universe_gate(ids.distinct().where("gene_id like 'E%'"), low=1, high=5))["passed"] is True


@pytest.mark.parametrize("mapped, status", [(8, "failed"), (9, "warning"), (10, "passed")])
def test_mapping_gate(spark, mapped, status):
    ids = spark.range(10).select(F.col("id").cast("string").alias("gene_id"))
    table = ids.where(F.col("gene_id").cast("int") < mapped).withColumns({"gene_symbol": F.lit("s"), "uniprot_accession": F.lit(None).cast("string")})
    assert one(E.mapping_gate(E.mapping_report(E.map_requested(ids, table))))["status"] == status
    assert E.unmapped_ids(E.map_requested(ids, table)).count() == 10 - mapped


def test_whole_run(spark, tmp_path):
    """Twenty entities with three planted controls: stages, verdict, report, ledger, and reuse on the second call."""
    known = ["MYO7A", "IFT88", "CDH23"]
    low = ["GAPDH", "ACTB"]
    names = known + low + [f"X{i:02d}" for i in range(15)]
    ids = spark.createDataFrame([(f"ENSG{i:02d}",) for i in range(20)], "gene_id string")
    mapping = spark.createDataFrame([(f"ENSG{i:02d}", s, None) for i, s in enumerate(names)], "gene_id string, gene_symbol string, uniprot_accession string")
    run = EvidenceRun(StageStore(spark, str(tmp_path / "store")), run_id="r")
    assert run.universe(ids, mapping, low=1, high=50).count() == 20
    base = lambda i: 0.9 if i < 3 else 0.1 if i < 5 else 0.3 + i / 50
    built = []
    for k, (stage, column) in enumerate(presets.LAYER_STAGES.values()):
        data = [(f"ENSG{i:02d}", base(i) + k / 1000) for i in range(20) if (i + k) % 6 or i < 5]
        run.store.save(spark.createDataFrame(data, f"gene_id string, {column} double"), stage)
        run.layer(stage, lambda: built.append(stage))
    assert built == [], "existing stages are reused"
    top = J.by_score(run.score()).limit(3).collect()
    assert {r["gene_symbol"] for r in top} == set(known)
    verdict = one(run.validate(K.control_set(spark, presets.POSITIVE_CONTROLS), K.control_set(spark, presets.NEGATIVE_CONTROLS), deltas=[0.1]))
    assert verdict["positive_passed"] and verdict["negative_passed"] and verdict["status"] in ("all_passed", "sensitivity_unstable")
    report = run.report(str(tmp_path / "out"))
    assert {r["gene_symbol"] for r in report.where("confidence_tier = 'HIGH'").collect()} == set(known)
    steps = [r["step_name"] for r in run.store.steps("r").collect()]
    assert steps == ["universe_gate", "mapping_gate", "score", "quality", "validate", "report"]
    sections = by_key(P.category_counts(run.summary(), "section"), "section", "n")
    assert sections["step"] == 6 and sections["parameter"] == 6 and sections["validation"] == 6
    with pytest.raises(KeyError):
        EvidenceRun(StageStore(spark, str(tmp_path / "empty"))).score()


def test_percent_rank_rows_match_window(spark):
    table = ranked_table(spark)
    got = K.rank_controls(table, table.select("gene_symbol", F.lit("all").alias("source")))
    want = table.withColumn("p", F.percent_rank().over(W.orderBy("composite_score")))
    assert by_key(got, "gene_symbol", "percentile_rank") == pytest.approx(by_key(want, "gene_symbol", "p"))


def test_two_sided_p_values(spark):
    from evidrank.operators.sweep import two_sided_p

    # From tables of Student's distribution: critical values for 0.05 and 0.01, and t = 0.
    known = [(12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.776, 4, 0.05), (2.228, 10, 0.05), (-2.042, 30, 0.05)]
    known += [(63.657, 1, 0.01), (3.169, 10, 0.01), (2.626, 100, 0.01), (2.612, 125, 0.01), (0.0, 7, 1.0), (50.0, 98, 0.0)]
    df = spark.createDataFrame(known, "t double, n long, p double")
    for r in df.withColumn("got", two_sided_p(F.col("t"), F.col("n"))).collect():
        assert r.got == pytest.approx(r.p, abs=2e-4)
