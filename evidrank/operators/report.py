"""Confidence tiers, evidence summaries, report aggregates and the dual-format sink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from evidrank.functions.rows import absent_names, ladder, present_names
from evidrank.sources.stages import cut, settle

# Lowest composite and layer count per tier.
TIERS = {
    "HIGH": {"composite_score": 0.7, "evidence_count": 3},
    "MEDIUM": {"composite_score": 0.4, "evidence_count": 2},
    "LOW": {"composite_score": 0.2},
}


def assign_tiers(df: DataFrame, tiers: Mapping[str, Mapping[str, float]] = TIERS) -> DataFrame:
    """Add ``confidence_tier``; rows that reach no tier (or have no composite) are left out.

    Tiers are tested in the given order; a tier that names no ``evidence_count`` asks for none.
    """
    cases = []
    for name, lowest in tiers.items():
        met = F.col("composite_score") >= lowest["composite_score"]
        if "evidence_count" in lowest:
            met = met & (F.col("evidence_count") >= lowest["evidence_count"])
        cases.append((met, name))
    return df.withColumn("confidence_tier", ladder(cases)).where(F.col("confidence_tier").isNotNull())


def evidence_summary(df: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Add ``supporting_layers`` and ``evidence_gaps``: comma-joined names of the known and the missing layers."""
    columns = {n: f"{n}_score" for n in layers}
    return df.withColumns({"supporting_layers": present_names(columns), "evidence_gaps": absent_names(columns)})


def category_counts(df: DataFrame, category: str) -> DataFrame:
    """Rows and share of rows per category (NULL is a category)."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("n") / total)


def layer_coverage(df: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Known scores per layer, all layers in one pass."""
    counted = df.agg(*[F.count(f"{n}_score").alias(n) for n in layers])
    return counted.unpivot([], list(layers), "layer", "n")


def score_histogram(df: DataFrame, bins: int = 30, score: str = "composite_score", tier: str = "confidence_tier") -> DataFrame:
    """Rows per equal-width bin between the lowest and highest score, per tier; the last bin includes the maximum."""
    x = F.col(score)
    span = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi")))
    lo, hi = span.scalar()["lo"], span.scalar()["hi"]
    place = F.floor(F.coalesce(F.try_divide(x - lo, F.nullif(hi - lo, F.lit(0.0))), F.lit(0.0)) * bins)
    binned = df.where(x.isNotNull()).withColumn("bin", F.least(place, F.lit(bins - 1)).cast("long"))
    return binned.groupBy("bin", tier).agg(F.count(F.lit(1)).alias("n"))


def write_dual(df: DataFrame, folder: str, base: str = "candidates", entity: str = "gene_id") -> DataFrame:
    """Write the rows, best score first and then by id, as TSV with header and as snappy Parquet.

    Returns one row with the number of rows, rows per tier and number of columns, observed during the write. One range
    shuffle and one sort serve both writers: the ordered rows are written once with their place, and both take the same
    partitions from there, so their part files hold the same rows in the same order. The range shuffle samples its input
    before it moves it, hence the settling.
    """
    order = [F.desc_nulls_last("composite_score"), F.asc(entity)]
    columns = [F.col(f"`{c}`") for c in df.columns]
    placed = settle(df).orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place"))
    tier = F.col("confidence_tier") if "confidence_tier" in df.columns else F.lit(None).cast("string")
    seen = Observation()
    kept = cut(
        placed.observe(
            seen,
            F.count(F.lit(1)).alias("total_candidates"),
            *[F.count_if(tier == t).alias(f"{t.lower()}_count") for t in ("HIGH", "MEDIUM", "LOW")],
            F.coalesce(F.max("_part"), F.lit(0)).alias("_last"),
        )
    )
    stats = {**seen.get, "column_count": len(df.columns)}
    dealt = kept.repartitionById(stats.pop("_last") + 1, F.col("_part")).sortWithinPartitions("_place")
    dealt.select(*columns).write.mode("overwrite").option("compression", "snappy").parquet(f"{folder}/{base}.parquet")
    nested = ("array", "struct", "map")
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f"`{f.name}`") for f in df.schema.fields]
    dealt.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/{base}.tsv")
    return df.sparkSession.createDataFrame([tuple(stats.values())], ", ".join(f"{k} bigint" for k in stats))


def top_rows(df: DataFrame, k: int, order: Sequence) -> DataFrame:
    """First k rows in a total order; each task keeps at most k."""
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """First k rows per group, limited inside each task before the shuffle."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_n") <= k).drop("_n")
