"""Expression layer: long-to-wide levels, versioned wide source, specificity index and enrichment score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.functions.joins import attach, keep_listed
from evidrank.functions.ranks import quantiles, with_percentile
from evidrank.functions.rows import all_known, any_known, known_max, known_mean, lookup, strip_version
from evidrank.sources.schema import backfill, lenient

# Numbers behind the level names, and score weights.
LEVELS = {"Not detected": 0.0, "Low": 1.0, "Medium": 2.0, "High": 3.0}
ENRICHMENT_WEIGHT, SPECIFICITY_WEIGHT, TARGET_WEIGHT = 0.4, 0.3, 0.3


def level_pivot(
    df: DataFrame,
    categories: Mapping[str, str],
    entity: str = "gene_symbol",
    category: str = "tissue",
    level: str = "level",
    levels: Mapping[str, float] = LEVELS,
) -> DataFrame:
    """Long (entity, category, level) rows to one row per entity with the highest level per wanted category.

    ``categories`` maps source category to output column. All columns come from one aggregation, so there is one
    shuffle and a hot entity is combined map-side; unknown level names are NULL.
    """
    number = lookup(level, levels)
    wanted = df.where(F.col(category).isin(*categories))
    cells = [F.max(F.when(F.col(category) == name, number)).alias(out) for name, out in categories.items()]
    return wanted.groupBy(entity).agg(*cells)


def versioned_wide(
    df: DataFrame,
    columns: Mapping[str, str],
    id_column: str = "Name",
    ids: DataFrame | None = None,
    entity: str = "gene_id",
) -> DataFrame:
    """Wide source keyed by versioned ids: wanted columns renamed and numeric, absent ones NULL, version stripped."""
    picked = [
        (lenient(F.col(f"`{source}`"), "double") if source in df.columns else F.lit(None).cast("double")).alias(out)
        for source, out in columns.items()
    ]
    wide = df.select(strip_version(F.col(f"`{id_column}`")).alias(entity), *picked)
    return wide if ids is None else keep_listed(wide, ids, entity)


def tau_specificity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``tau_specificity`` = sum(1 - x/max) / (n - 1); NULL if any value is missing, max <= 0 or n <= 1."""
    have = [c for c in columns if c in df.columns]
    if len(have) <= 1:
        return df.withColumn("tau_specificity", F.lit(None).cast("double"))
    top = known_max([F.col(c).cast("double") for c in have])
    spread = sum((F.lit(1.0) - F.col(c) / F.when(top > 0, top) for c in have), F.lit(0.0))
    return df.withColumn("tau_specificity", F.when(all_known(have) & (top > 0), spread / (len(have) - 1)))


def expression_score(df: DataFrame, target: Sequence[str], every: Sequence[str]) -> DataFrame:
    """Add ``target_enrichment`` and ``expression_score_normalized``.

    Enrichment is mean(target) / mean(every), NULL unless mean(every) > 0. The score weighs the enrichment percentile,
    the specificity and the percentile of the highest target value; a missing part counts as zero, and the score is
    NULL only when enrichment and specificity are both missing.
    """
    target = [c for c in target if c in df.columns]
    every = [c for c in every if c in df.columns]
    nothing = F.lit(None).cast("double")
    if not target or not every:
        return df.withColumns({"target_enrichment": nothing, "expression_score_normalized": nothing})
    overall = known_mean(every)
    ranked = with_percentile(
        df.withColumns(
            {
                "target_enrichment": F.try_divide(known_mean(target), F.when(overall > 0, overall)),
                "_target_max": known_max([F.col(c).cast("double") for c in target]),
            }
        ),
        {"_enrichment_pct": "target_enrichment", "_target_pct": "_target_max"},
    )
    zero = F.lit(0.0)
    score = (
        ENRICHMENT_WEIGHT * F.coalesce("_enrichment_pct", zero)
        + SPECIFICITY_WEIGHT * F.coalesce("tau_specificity", zero)
        + TARGET_WEIGHT * F.coalesce("_target_pct", zero)
    )
    known = any_known(["target_enrichment", "tau_specificity"])
    return ranked.withColumn("expression_score_normalized", F.when(known, score)).drop(
        "_enrichment_pct", "_target_pct", "_target_max"
    )


def expression_layer(
    ids: DataFrame,
    by_id: DataFrame,
    by_symbol: DataFrame | None,
    symbol_map: DataFrame | None,
    target: Sequence[str],
    every: Sequence[str],
) -> DataFrame:
    """Requested ids joined with an id-keyed source and, over the symbol map, a symbol-keyed one; then the scores.

    Columns no source provides are back-filled after scoring, so they do not enter the specificity.
    """
    merged = attach(ids.select("gene_id"), by_id, "gene_id")
    if by_symbol is not None and symbol_map is not None:
        bridged = by_symbol.join(symbol_map.select("gene_id", "gene_symbol"), "gene_symbol")
        merged = attach(merged, bridged.drop("gene_symbol"), "gene_id")
    if symbol_map is not None:
        names = symbol_map.groupBy("gene_id").agg(F.min("gene_symbol").alias("gene_symbol"))
        merged = attach(merged, names, "gene_id")
    merged = tau_specificity(merged, every)
    return backfill(expression_score(merged, target, every), {c: "double" for c in every})


def expression_summary(df: DataFrame, near: Sequence[str], far: Sequence[str]) -> DataFrame:
    """Rows with any value in each of two column groups, mean specificity, score range, mean and median."""
    score = "expression_score_normalized"
    near, far = [c for c in near if c in df.columns], [c for c in far if c in df.columns]
    present = lambda cols: F.count_if(any_known(cols)) if cols else F.lit(0).cast("long")
    stats = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        present(near).alias("near_count"),
        present(far).alias("far_count"),
        F.avg("tau_specificity").alias("mean_tau"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"),
    )
    return stats.withColumn("median_score", quantiles(df, score, {"median": 0.5}).scalar())


def enriched_entities(df: DataFrame, at_least: float = 2.0, extra: Sequence[str] = ()) -> DataFrame:
    """Rows with enrichment at or over the threshold, highest first."""
    return (
        df.where(F.col("target_enrichment") >= at_least)
        .select(
            "gene_id", "gene_symbol", "target_enrichment", "tau_specificity", "expression_score_normalized", *extra
        )
        .orderBy(F.desc("target_enrichment"), "gene_id")
    )
