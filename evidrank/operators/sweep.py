"""Weight-sensitivity sweep: every perturbed composite, its top list and its rank agreement, in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrank.operators.composite import check_weights, composite_sql
from evidrank.sources.stages import cut

# Default perturbations, list length, stability limit and smallest overlap for a correlation.
DEFAULT_DELTAS = (-0.10, -0.05, 0.05, 0.10)
TOP_N = 100
STABLE_RHO = 0.85
MIN_OVERLAP = 10
#: Rows, as a multiple of the list length, from which the entry bounds of the lists are taken.
LEADERS = 4


def perturb_weights(weights: Mapping[str, float], layer: str, delta: float) -> dict[str, float]:
    """Shift one weight, clamp it to [0, 1] and renormalise all; all zero becomes uniform."""
    if layer not in weights:
        raise ValueError(f"unknown layer {layer!r}; known: {', '.join(weights)}")
    moved = {n: min(1.0, max(0.0, w + delta)) if n == layer else w for n, w in weights.items()}
    total = sum(moved.values())
    return {n: w / total if total > 0 else 1.0 / len(moved) for n, w in moved.items()}


def scenarios(
    weights: Mapping[str, float], deltas: Sequence[float] = DEFAULT_DELTAS
) -> list[tuple[str, float, dict[str, float]]]:
    """(layer, delta, weights) for each layer and shift."""
    return [(n, float(d), perturb_weights(weights, n, d)) for n in weights for d in deltas]


def weight_scenarios(baseline: DataFrame, deltas: Sequence[float] = DEFAULT_DELTAS) -> DataFrame:
    """The same scenarios from a one-row table of baseline weights (one column per layer), as long rows.

    Output: ``target_layer, delta, layer, weight``; for weights that are themselves computed from data.
    """
    layers = baseline.columns
    grid = F.array(
        *[F.struct(F.lit(n).alias("target_layer"), F.lit(float(d)).alias("delta")) for n in layers for d in deltas]
    )
    moved = [
        F.when(
            F.col("target_layer") == n, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(n) + F.col("delta")))
        )
        .otherwise(F.col(n))
        .alias(n)
        for n in layers
    ]
    rows = baseline.select("*", F.inline(grid)).select("target_layer", "delta", *moved)
    total = sum((F.col(n) for n in layers), F.lit(0.0))
    shares = [F.when(total > 0, F.col(n) / total).otherwise(F.lit(1.0 / len(layers))).alias(n) for n in layers]
    return rows.select("target_layer", "delta", *shares).unpivot(
        ["target_layer", "delta"], list(layers), "layer", "weight"
    )


def scenario_score(weights: Mapping[str, float], digits: int | None = None) -> str:
    """The composite under one weighting, as SQL text."""
    score = composite_sql(weights)
    return score if digits is None else f"round({score}, {digits})"


def _group_key(entity: str, symbol: str) -> Column:
    """What stands for a symbol; a row without a symbol stands for itself."""
    own = F.concat(F.lit("id:"), F.col(entity).cast("string"))
    return F.coalesce(F.concat(F.lit("symbol:"), F.col(symbol).cast("string")), own)


def _top(ranked: DataFrame, top_n: int, entity: str) -> DataFrame:
    """The first rows of each scenario; limited inside each task first, so few rows per task are shuffled."""
    first = Window.partitionBy("scenario").orderBy(F.desc("composite"), F.asc(entity))
    return ranked.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= top_n)


def entry_bounds(
    joined: DataFrame,
    plans: Sequence[Mapping[str, float]],
    top_n: int = TOP_N,
    entity: str = "gene_id",
    symbol: str = "gene_symbol",
    digits: int | None = None,
) -> list[float | None]:
    """Per scenario, a composite that no row of its top list is below; None if none is known.

    The symbols of the best rows under the first weighting, a few times ``top_n``, are scored exactly in every scenario.
    The composite of the ``top_n``-th of them is such a bound: the whole list cannot end lower. One number a scenario
    reaches the driver. Too few symbols among those rows only mean that nothing is pruned.
    """
    keyed = joined.withColumn("_group", _group_key(entity, symbol))
    first = F.expr(scenario_score(plans[0], digits))
    lead = keyed.where(first.isNotNull()).orderBy(first.desc(), entity).limit(LEADERS * top_n).select("_group").distinct()
    few = keyed.join(F.broadcast(lead), "_group", "left_semi").drop("_group")  # at most LEADERS * top_n keys
    listed = _top(best_by_scenario(few, plans, entity, symbol, digits), top_n, entity)
    found = listed.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.min("composite").alias("least")).where(F.col("n") == top_n)
    bounds = {r["scenario"]: r["least"] for r in found.collect()}
    return [bounds.get(i) for i in range(len(plans))]


def contenders(
    joined: DataFrame,
    plans: Sequence[Mapping[str, float]],
    bounds: Sequence[float | None],
    entity: str = "gene_id",
    symbol: str = "gene_symbol",
    digits: int | None = None,
) -> DataFrame:
    """The rows of every symbol with a row that reaches the bound of some scenario; no other symbol enters a top list.

    A row is tested by itself, in one scan, under all weightings; nothing is grouped. All rows of a symbol that stays
    are kept, since another of them may be the one that stands for it.
    """
    if any(b is None for b in bounds):
        return joined
    reaches = " or ".join(f"{scenario_score(w, digits)} >= double('{b!r}')" for w, b in zip(plans, bounds))
    keyed = joined.withColumn("_group", _group_key(entity, symbol))
    return keyed.join(keyed.where(reaches).select("_group").distinct(), "_group", "left_semi").drop("_group")


def best_by_scenario(
    joined: DataFrame,
    plans: Sequence[Mapping[str, float]],
    entity: str = "gene_id",
    symbol: str = "gene_symbol",
    digits: int | None = None,
) -> DataFrame:
    """Per symbol and scenario, the composite of the kept row: most layers, then best composite, then smallest id.

    Input rows are not multiplied by the number of scenarios. One aggregation holds a running best per scenario,
    combined map-side so a hot symbol sends one row per task; only its results, one per symbol, are expanded to
    ``scenario, symbol, entity, composite``, one row per symbol and scenario. Rows without a symbol are never collapsed.
    """

    def kept(weights: Mapping[str, float]) -> str:
        score = scenario_score(weights, digits)
        lower = f"coalesce(-({score}), double('Infinity'))"
        return f"min(struct(-evidence_count as fewer, {lower} as lower, `{entity}` as id))"

    alone = F.when(F.col(symbol).isNull(), F.col(entity)).alias("_alone")
    best = joined.groupBy(symbol, alone).agg(*[F.expr(f"{kept(w)} as _s{i}") for i, w in enumerate(plans)])
    entries = [f"struct({i} as scenario, _s{i}.id as `{entity}`, -_s{i}.lower as composite)" for i in range(len(plans))]
    rows = best.select(symbol, F.expr(f"inline(array({', '.join(entries)}))"))
    return rows.where("composite > double('-Infinity')")


def sensitivity_sweep(
    joined: DataFrame,
    weights: Mapping[str, float],
    deltas: Sequence[float] = DEFAULT_DELTAS,
    top_n: int = TOP_N,
    entity: str = "gene_id",
    symbol: str = "gene_symbol",
    match_on: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Spearman correlation between the baseline and each perturbed top list over their common symbols.

    Takes the undeduplicated evidence join. Columns: ``layer, delta, spearman_rho, overlap_count, top_n,
    perturbed_weights, t_statistic, p_value``. ``spearman_rho`` is NULL under ten common entries.

    Before any scenario is aggregated, symbols that cannot enter any list are left out by bounds (``entry_bounds``); the
    running bests are then kept for the few that can. The join is written once, as it is scanned three times.
    """
    check_weights(weights)
    grid = scenarios(weights, deltas)
    match = match_on or symbol
    plans = [dict(weights), *[w for *_, w in grid]]
    own = [entity, symbol, "evidence_count", *[f"{n}_score" for n in weights], match]
    joined = cut(joined.select(*dict.fromkeys(own)))
    few = contenders(joined, plans, entry_bounds(joined, plans, top_n, entity, symbol, digits), entity, symbol, digits)
    top = _top(best_by_scenario(few, plans, entity, symbol, digits), top_n, entity)
    top = top.where(F.col(match).isNotNull()).select("scenario", match, "composite")
    # at most top_n rows per scenario from here on; the baseline meets the others through one group per entry
    base = F.max(F.when(F.col("scenario") == 0, F.col("composite"))).over(Window.partitionBy(match))
    pairs = top.withColumn("_base", base).where((F.col("scenario") > 0) & F.col("_base").isNotNull())
    return _agreement(pairs, grid, top_n)


def _agreement(pairs: DataFrame, grid: Sequence[tuple[str, float, Mapping[str, float]]], top_n: int) -> DataFrame:
    def average_rank(c: str):
        ties = F.count(F.lit(1)).over(Window.partitionBy("scenario", c))
        return F.rank().over(Window.partitionBy("scenario").orderBy(c)) + (ties - 1) / F.lit(2.0)

    ranks = pairs.withColumns({"_rank_base": average_rank("_base"), "_rank_new": average_rank("composite")})
    found = ranks.groupBy("scenario").agg(
        F.corr("_rank_base", "_rank_new").alias("_rho"), F.count(F.lit(1)).alias("overlap_count")
    )
    spark = pairs.sparkSession
    plan = spark.createDataFrame(
        [(i, layer, delta, dict(w)) for i, (layer, delta, w) in enumerate(grid, start=1)],
        "scenario int, layer string, delta double, perturbed_weights map<string,double>",
    )
    overlap = F.coalesce("overlap_count", F.lit(0))
    rho = F.when((overlap >= MIN_OVERLAP) & ~F.isnan("_rho"), F.col("_rho"))
    out = plan.join(found, "scenario", "left").select(
        "layer",
        "delta",
        rho.alias("spearman_rho"),
        overlap.alias("overlap_count"),
        F.lit(top_n).cast("long").alias("top_n"),
        "perturbed_weights",
    )
    spread = F.nullif(F.greatest(F.lit(0.0), 1 - F.col("spearman_rho") * F.col("spearman_rho")), F.lit(0.0))
    t = F.col("spearman_rho") * F.sqrt(F.try_divide(F.col("overlap_count") - 2, spread))
    out = out.withColumn("t_statistic", t)
    exact = F.when(F.abs("spearman_rho") >= 1, 0.0)  # a perfect agreement has no finite t
    return out.withColumn("p_value", F.coalesce(exact, two_sided_p(F.col("t_statistic"), F.col("overlap_count") - 2)))


def two_sided_p(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom: a finite sum of powers of the cosine of
    atan(t / sqrt(freedom)), in built-in functions."""
    n = freedom.cast("double")
    angle = F.atan(F.abs(t) / F.sqrt(n))
    sine, square = F.sin(angle), F.cos(angle) * F.cos(angle)
    odd = freedom % 2 == 1
    # Terms after the first; each is the one before times (k - 1) / k for k = 2, 4, ... or 3, 5, ..., times cos**2.
    steps = F.when(freedom >= 4, F.sequence(F.when(odd, 3).otherwise(2).cast("long"), freedom.cast("long") - 2, F.lit(2).cast("long")))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * (k - 1) / k * square
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    total = F.aggregate(F.coalesce(steps, F.array().cast("array<bigint>")), zero, add)["sum"]
    inside = F.when(odd, 2 / F.lit(pi) * (angle + F.when(freedom > 1, sine * F.cos(angle) * total).otherwise(0.0))).otherwise(sine * total)
    return F.when(freedom > 0, F.greatest(F.lit(0.0), 1 - inside))


def sweep_summary(sweep: DataFrame, limit: float = STABLE_RHO) -> DataFrame:
    """Range and mean of the correlations, stable and unstable counts, most sensitive and most robust layer: one row.

    Scenarios without a correlation are left out everywhere but in the total; with none left the sweep is not stable.
    """
    rho = F.col("spearman_rho")
    per_layer = sweep.where(rho.isNotNull()).groupBy("layer").agg(F.avg("spearman_rho").alias("_mean"))
    edges = per_layer.agg(
        F.struct(
            F.min(F.struct("_mean", "layer"))["layer"].alias("low"),
            F.min(F.struct((-F.col("_mean")).alias("m"), "layer"))["layer"].alias("high"),
        )
    )
    stable, known = F.count_if(rho >= limit), F.count(rho)
    return sweep.agg(
        F.min(rho).alias("min_rho"),
        F.max(rho).alias("max_rho"),
        F.avg(rho).alias("mean_rho"),
        stable.alias("stable_count"),
        (known - stable).alias("unstable_count"),
        F.count(F.lit(1)).alias("total_perturbations"),
        ((known > 0) & (known == stable)).alias("overall_stable"),
    ).withColumns({"most_sensitive_layer": edges.scalar()["low"], "most_robust_layer": edges.scalar()["high"]})
