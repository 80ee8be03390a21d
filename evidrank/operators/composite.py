"""Evidence join, NULL-aware weighted composite and best-row-per-symbol."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import fsum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrank.functions.rows import filled_sum, known_count, ladder

# Default layer weights.
DEFAULT_WEIGHTS = {
    "gnomad": 0.20,
    "expression": 0.20,
    "annotation": 0.15,
    "localization": 0.15,
    "animal_model": 0.15,
    "literature": 0.15,
}
WEIGHT_TOLERANCE = 1e-6


def check_weights(weights: Mapping[str, float]) -> None:
    bad = [k for k, w in weights.items() if not 0.0 <= w <= 1.0]
    if bad:
        raise ValueError(f"weights outside [0, 1]: {', '.join(bad)}")
    total = fsum(weights.values())
    if abs(total - 1.0) > WEIGHT_TOLERANCE:
        raise ValueError(f"weights must sum to 1, got {total:.6f}")


def evidence_join(
    universe: DataFrame,
    layers: Mapping[str, tuple[DataFrame, str]],
    entity: str = "gene_id",
    symbol: str = "gene_symbol",
    dedupe: bool = True,
) -> DataFrame:
    """Universe with the highest score per layer (``<layer>_score``) and ``evidence_count``.

    ``layers`` maps a layer name to its table and score column. A left join of the universe to n aggregated layers is
    one grouped aggregation over their union: one shuffle on the key in place of n + 1, combined map-side so a hot key
    costs one row per task, and no sort-merge joins. Rows without a universe entry drop out at the end; a layer row
    without an id meets no entity, not even one without an id.
    """
    names = list(layers)
    empty = {n: F.lit(None).cast("double") for n in names}

    def tagged(df: DataFrame, sym: Column, member: bool, filled: Mapping[str, Column]) -> DataFrame:
        scores = [filled.get(n, empty[n]).alias(f"{n}_score") for n in names]
        return df.select(F.col(entity), sym.alias(symbol), F.lit(member).alias("_member"), *scores)

    rows = tagged(universe, F.col(symbol), True, {})
    for name, (df, column) in layers.items():
        part = tagged(df.where(F.col(entity).isNotNull()), F.lit(None).cast("string"), False, {name: F.col(column).cast("double")})
        rows = rows.unionByName(part)
    joined = (
        rows.groupBy(entity)
        .agg(
            F.min(symbol).alias(symbol),
            F.max("_member").alias("_member"),
            *[F.max(f"{n}_score").alias(f"{n}_score") for n in names],
        )
        .where(F.col("_member"))
        .drop("_member")
        .withColumn("evidence_count", known_count([f"{n}_score" for n in names]))
    )
    return best_per_symbol(joined, [F.desc("evidence_count")], entity, symbol) if dedupe else joined


def best_per_symbol(
    df: DataFrame, order: Sequence[Column], entity: str = "gene_id", symbol: str = "gene_symbol"
) -> DataFrame:
    """First row per symbol in the given order, then by id. Rows without a symbol are never collapsed.

    ``row_number() = 1`` is limited inside each map task before the shuffle, so a hot symbol sends one row per task.
    """
    alone = F.when(F.col(symbol).isNull(), F.col(entity))
    first = Window.partitionBy(symbol, alone).orderBy(*order, F.asc(entity))
    return df.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")


def composite_sql(weights: Mapping[str, float]) -> str:
    """Weighted mean over the known layers, as SQL text; NULL when their weight adds up to zero.

    Text, because a sweep needs dozens of these and one parse is far cheaper than hundreds of calls into the JVM.
    """
    top = " + ".join(f"coalesce(`{n}_score` * {float(w)!r}D, 0D)" for n, w in weights.items())
    bottom = " + ".join(f"if(`{n}_score` is null, 0D, {float(w)!r}D)" for n, w in weights.items())
    return f"try_divide({top}, nullif({bottom}, 0D))"


def composite_of(weights: Mapping[str, float]) -> Column:
    return F.expr(composite_sql(weights))


def available_weight(weights: Mapping[str, float]) -> Column:
    return filled_sum([F.when(F.col(f"{n}_score").isNotNull(), F.lit(float(w))) for n, w in weights.items()])


def weighted_sum(weights: Mapping[str, float]) -> Column:
    return filled_sum([F.col(f"{n}_score") * F.lit(float(w)) for n, w in weights.items()])


def evidence_quality(count: Column) -> Column:
    return ladder(
        [(count >= 4, "sufficient_evidence"), (count >= 2, "moderate_evidence"), (count >= 1, "sparse_evidence")],
        "no_evidence",
    )


def weighted_composite(
    joined: DataFrame,
    weights: Mapping[str, float] = DEFAULT_WEIGHTS,
    entity: str = "gene_id",
    symbol: str = "gene_symbol",
    dedupe: bool = True,
) -> DataFrame:
    """Add available weight, weighted sum, composite, quality flag and one contribution per layer.

    Takes the undeduplicated evidence join; the row kept per symbol has the most layers, then the best composite.
    """
    check_weights(weights)
    scored = joined.withColumns(
        {
            "available_weight": available_weight(weights),
            "weighted_sum": weighted_sum(weights),
            "composite_score": composite_of(weights),
            "quality_flag": evidence_quality(F.col("evidence_count")),
            **{f"{n}_contribution": F.col(f"{n}_score") * F.lit(float(w)) for n, w in weights.items()},
        }
    )
    if not dedupe:
        return scored
    return best_per_symbol(scored, [F.desc("evidence_count"), F.desc_nulls_last("composite_score")], entity, symbol)


def by_score(df: DataFrame, entity: str = "gene_id") -> DataFrame:
    """Composite score descending with unknown scores last, then id."""
    return df.orderBy(F.desc_nulls_last("composite_score"), F.asc(entity))
