"""Positive and negative control sets: percentile ranks, summaries, recall at k and the overall verdict."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrank.functions.ranks import attach_table, measure_bounds, percent_rank_table, probe_positions, quantiles
from evidrank.functions.rows import ladder
from evidrank.sources.stages import cut, settle

# Validation thresholds, reported list length, recall cut-offs.
POSITIVE_MEDIAN, NEGATIVE_MEDIAN, TOP_QUARTILE, HIGH_SCORE = 0.75, 0.50, 0.75, 0.70
DETAIL_ROWS = 20
RECALL_KS, RECALL_FRACTIONS = (100, 500, 1000, 2000), (0.05, 0.10, 0.20)


def control_set(spark: SparkSession, members: Mapping[str, Iterable[str]], confidence: str = "HIGH") -> DataFrame:
    """``gene_symbol, source, confidence`` from named member lists; a symbol listed by two sources has two rows."""
    rows = [(symbol, source, confidence) for source, symbols in members.items() for symbol in symbols]
    return spark.createDataFrame(rows, "gene_symbol string, source string, confidence string")


def rank_controls(
    scored: DataFrame, controls: DataFrame, on: str = "gene_symbol", keep: Sequence[str] = ("source",), stored: bool = False
) -> DataFrame:
    """Scored controls with their PERCENT_RANK among all known composites, one row per (entity, source).

    Several control sets are ranked at once if their union, with the set among the columns to ``keep``, is given.

    The controls are joined first and only they receive a rank, so the full table is shuffled once, collapsed to its
    distinct scores. Size decides at run time whether the control side is broadcast. The result, no larger than the
    control set, is written once because each summary reads it several times. Scores that are ``stored`` in a table are
    not written again.
    """
    known = scored.where(F.col("composite_score").isNotNull()).select(on, "composite_score")
    known = known if stored else settle(known)
    bounds = measure_bounds(known, {"v": "composite_score"})["v"]
    matched = known.join(controls.select(on, *keep), on)
    return cut(attach_table(matched, percent_rank_table(known, "composite_score", bounds), "composite_score", bounds))


def _placement(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("percentile_rank") >= TOP_QUARTILE).alias("top_quartile_count"),
        F.count_if(F.col("composite_score") >= HIGH_SCORE).alias("high_score_count"),
    )
    medians = quantiles(ranked, "percentile_rank", {"median_percentile": 0.5}, by=by)
    if by:
        return counts.join(medians, list(by), "left")
    return counts.withColumn("median_percentile", medians.scalar())


def control_summary(
    ranked: DataFrame,
    controls: DataFrame,
    positive: bool = True,
    threshold: float | None = None,
    on: str = "gene_symbol",
) -> DataFrame:
    """One row: expected and found controls, median percentile, top-quartile and high-score counts, pass or reason.

    An entity listed by several sources counts once. Positive controls pass with a median at or over the threshold,
    negative ones with a median below it.
    """
    limit = threshold if threshold is not None else (POSITIVE_MEDIAN if positive else NEGATIVE_MEDIAN)
    once = ranked.drop("source").distinct()
    placed = _placement(once, [])
    median = F.col("median_percentile")
    passed = median >= limit if positive else median < limit
    return placed.select(
        controls.agg(F.count_distinct(on)).scalar().alias("total_expected"),
        F.col("n").alias("total_in_dataset"),
        "median_percentile",
        "top_quartile_count",
        F.coalesce(F.try_divide(F.col("top_quartile_count"), F.col("n")), F.lit(0.0)).alias("top_quartile_fraction"),
        "high_score_count",
        F.coalesce(passed, F.lit(False)).alias("validation_passed"),
        ladder(
            [(F.col("n") == 0, "no_controls_found"), (~passed, "median_over_limit" if not positive else "median_under_limit")],
            F.lit(None).cast("string"),
        ).alias("reason"),
    )


def control_by_source(ranked: DataFrame, controls: DataFrame) -> DataFrame:
    """Median percentile, count and top-quartile count per source, in one job; sources without a match show zero."""
    placed = _placement(ranked, ["source"])
    return (
        controls.select("source")
        .distinct()
        .join(placed, "source", "left")
        .select(
            "source",
            "median_percentile",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce("top_quartile_count", F.lit(0)).alias("top_quartile_count"),
        )
    )


def control_details(ranked: DataFrame, best_first: bool = True, k: int = DETAIL_ROWS, on: str = "gene_symbol") -> DataFrame:
    """The k highest-ranked (or lowest-ranked) controls."""
    order = F.desc("percentile_rank") if best_first else F.asc("percentile_rank")
    return ranked.select(on, "composite_score", "percentile_rank", "source").orderBy(order, on, "source").limit(k)


def recall_at_k(
    scored: DataFrame,
    controls: DataFrame,
    ks: Sequence[int] = RECALL_KS,
    fractions: Sequence[float] = RECALL_FRACTIONS,
    on: str = "gene_symbol",
    score: str = "composite_score",
    stored: bool = False,
) -> DataFrame:
    """``threshold, k, hits, total_known, recall`` for absolute and percentage cut-offs of one global ordering.

    Only the controls get their exact position by (score descending, entity), from counts of the rows that stand before
    them (``probe_positions``); the scored rows are neither sorted nor numbered. Every cut-off is then a conditional
    count over those positions.
    """
    known = scored.where(F.col(score).isNotNull() & ~F.isnan(score)).select(on, score)
    known = known if stored else settle(known)
    total = known.agg(F.count(F.lit(1))).scalar()
    unique = controls.select(on).where(F.col(on).isNotNull()).distinct()
    cut_offs = [(str(k), F.lit(k).cast("long")) for k in ks]
    cut_offs += [(f"{int(f * 100)}%", F.floor(total * F.lit(f)).cast("long")) for f in fractions]
    # an entity with several rows counts once, at its best position
    best = cut(known.join(unique, on, "left_semi").groupBy(on).agg(F.max(score).alias(score)))
    counted = probe_positions(known, best, score, on).agg(
        *[F.count_if(F.col("position") <= k).alias(f"h{i}") for i, (_, k) in enumerate(cut_offs)]
    ).withColumn("total_known", unique.agg(F.count(F.lit(1))).scalar())
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("threshold"), k.alias("k"), F.col(f"h{i}").alias("hits"))
            for i, (name, k) in enumerate(cut_offs)
        ]
    )
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("total_known")), F.lit(0.0))
    return (
        counted.select("total_known", F.inline(rows))
        .select("threshold", "k", "hits", "total_known")
        .withColumn("recall", recall)
    )


def extended_controls(
    scored: DataFrame, controls: DataFrame, ks: Sequence[int] = RECALL_KS, on: str = "gene_symbol", threshold: float | None = None
) -> DataFrame:
    """Summary, recall at every cut-off and placement per source of a positive control set: ``section, name, value``."""
    scored = settle(scored.select(on, "composite_score"))
    ranked = rank_controls(scored, controls, on, stored=True)
    summary = control_summary(ranked, controls, threshold=threshold, on=on)
    numbers = ["total_expected", "total_in_dataset", "median_percentile", "top_quartile_count", "top_quartile_fraction", "high_score_count"]
    cast = [F.col(c).cast("double").alias(c) for c in numbers]
    rows = summary.select(*cast).unpivot([], numbers, "name", "value").select(F.lit("summary").alias("section"), "name", "value")
    recall = recall_at_k(scored, controls, ks, on=on, stored=True).select(F.lit("recall").alias("section"), F.col("threshold").alias("name"), F.col("recall").alias("value"))
    sources = control_by_source(ranked, controls)
    placed = sources.select(F.lit("source").alias("section"), F.col("source").alias("name"), F.col("median_percentile").alias("value"))
    return rows.unionByName(recall).unionByName(placed)


def verdict_of(positive: Column, negative: Column, stable: Column) -> Column:
    """Overall status from three outcomes; a sweep that was not run (NULL) leaves the status unknown."""
    return ladder(
        [
            (~positive, "failed"),
            (~negative, "specificity_issue"),
            (~stable, "sensitivity_unstable"),
            (stable, "all_passed"),
        ],
        "sensitivity_not_run",
    )


def validation_verdict(positive: DataFrame, negative: DataFrame, sweep_summary: DataFrame | None = None) -> DataFrame:
    """One row with the three outcomes and the overall status."""
    ok = positive.select("validation_passed").withColumnRenamed("validation_passed", "positive_passed")
    stable = sweep_summary.select("overall_stable").scalar() if sweep_summary is not None else F.lit(None).cast("boolean")
    return ok.withColumns(
        {"negative_passed": negative.select("validation_passed").scalar(), "sensitivity_stable": stable}
    ).withColumn("status", verdict_of(F.col("positive_passed"), F.col("negative_passed"), F.col("sensitivity_stable")))
