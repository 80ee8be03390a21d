"""Data-quality checks over a scored table: missing rates, distributions, outliers, composite statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.functions.ranks import quantiles
from evidrank.functions.rows import ladder, lookup
from evidrank.operators.report import top_per_group

# Check limits, and the factor that makes a MAD comparable to a standard deviation.
MISSING_WARN, MISSING_ERROR = 0.5, 0.8
MIN_STD = 0.01
OUTLIER_MADS = 3.0
NORMAL_MAD = 1.482602218505602


def long_scores(df: DataFrame, layers: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One ``layer, score`` row per entity and layer."""
    renamed = df.select(*keep, *[F.col(f"{n}_score").cast("double").alias(n) for n in layers])
    return renamed.unpivot(list(keep), list(layers), "layer", "score")


def missing_rates(df: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Share of NULLs per layer and its severity, all layers in one pass."""
    rates = df.agg(*[F.avg(F.col(f"{n}_score").isNull().cast("double")).alias(n) for n in layers])
    rate = F.col("missing_rate")
    severity = ladder([(rate > MISSING_ERROR, "error"), (rate > MISSING_WARN, "warning")], "ok")
    return rates.unpivot([], list(layers), "layer", "missing_rate").withColumn("severity", severity)


def distribution_stats(df: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Mean, median, population std, min, max and count of the known scores per layer, and the severity."""
    rows = long_scores(df, layers)
    stats = rows.groupBy("layer").agg(
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
        F.count("score").alias("count"),
    )
    medians = quantiles(rows, "score", {"median": 0.5}, by=["layer"])
    severity = ladder(
        [
            (F.col("count") == 0, "warning"),
            ((F.col("min") < 0.0) | (F.col("max") > 1.0), "error"),
            (F.col("std") < MIN_STD, "warning"),
        ],
        "ok",
    )
    out = stats.join(medians, "layer", "left").withColumn("severity", severity)
    return out.select("layer", "mean", "median", "std", "min", "max", "count", "severity")


def deviation_limits(rows: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Median and normal-scaled MAD of ``score`` per ``layer``: one row per layer, whatever the table size.

    The medians come back as one number per layer and enter the second pass as a map literal, so the first pass is not
    planned and run again inside it.
    """
    medians = quantiles(rows, "score", {"median": 0.5}, by=["layer"]).collect()  # at most one row per layer
    center = {r["layer"]: r["median"] for r in medians}
    mid = lookup("layer", {n: center.get(n, float("nan")) for n in layers})
    gaps = rows.select("layer", F.abs(F.col("score") - mid).alias("_gap"))
    mads = quantiles(gaps, "_gap", {"_mad": 0.5}, by=["layer"])
    return mads.select("layer", mid.alias("median"), (F.col("_mad") * NORMAL_MAD).alias("mad"))


def outlier_rows(df: DataFrame, layers: Sequence[str], entity: str = "gene_symbol") -> DataFrame:
    """Every (layer, entity, score) further than three MADs from the layer's median; none where the MAD is zero."""
    rows = long_scores(df, layers, [entity]).where(F.col("score").isNotNull())
    limits = deviation_limits(rows, layers)
    far = F.abs(F.col("score") - F.col("median")) > OUTLIER_MADS * F.col("mad")
    # one row per layer on the broadcast side
    return rows.join(F.broadcast(limits), "layer").where((F.col("mad") > 1e-8) & far).select("layer", entity, "score")


def mad_outliers(df: DataFrame, layers: Sequence[str], entity: str = "gene_symbol", examples: int = 5) -> DataFrame:
    """Number of outliers per layer and the first few entities by name; layers without outliers show zero."""
    far = outlier_rows(df, layers, entity)
    counts = far.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    few = top_per_group(far, ["layer"], [F.asc(entity)], examples)
    listed = few.groupBy("layer").agg(F.array_sort(F.collect_list(entity)).alias("examples"))
    names = df.sparkSession.createDataFrame([(n,) for n in layers], "layer string")
    return (
        names.join(counts, "layer", "left")
        .join(listed, "layer", "left")
        .select("layer", F.coalesce("n", F.lit(0)).alias("outlier_count"), "examples")
    )


def composite_stats(df: DataFrame, score: str = "composite_score") -> DataFrame:
    """Mean, median, sample std, range, deciles and quartiles, and row counts of the composite: one row."""
    marks = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
    base = df.agg(
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
        F.count(F.lit(1)).alias("total"),
        F.count(score).alias("non_null"),
    )
    q = quantiles(df, score, marks).select(F.struct(*marks).alias("q")).scalar()
    return base.select(
        "mean", q["p50"].alias("median"), "std", "min", "max", *[q[m].alias(m) for m in marks], "total", "non_null"
    )


def qc_findings(df: DataFrame, layers: Sequence[str]) -> DataFrame:
    """All warnings and errors as one table: ``check_name, layer, severity, message``."""
    missing = missing_rates(df, layers).where(F.col("severity") != "ok")
    missing = missing.select(
        F.lit("missing_data").alias("check_name"),
        "layer",
        "severity",
        F.format_string("%s: %.1f%% missing", F.col("layer"), F.col("missing_rate") * 100).alias("message"),
    )
    spread = distribution_stats(df, layers)
    out_of_range = (F.col("min") < 0.0) | (F.col("max") > 1.0)
    cases = F.array(
        F.when(F.col("count") == 0, _finding("warning", F.format_string("%s: no data available", F.col("layer")))),
        F.when(
            F.col("std") < MIN_STD,
            _finding("warning", F.format_string("%s: no variation (std=%.4f)", F.col("layer"), F.col("std"))),
        ),
        F.when(
            out_of_range,
            _finding(
                "error",
                F.format_string("%s: out of range (min=%.4f, max=%.4f)", F.col("layer"), F.col("min"), F.col("max")),
            ),
        ),
    )
    spread = spread.select("layer", F.explode(F.array_compact(cases)).alias("f"))
    spread = spread.select(F.lit("distribution").alias("check_name"), "layer", "f.severity", "f.message")
    return missing.unionByName(spread)


def _finding(severity: str, message):
    return F.struct(F.lit(severity).alias("severity"), message.alias("message"))


def qc_verdict(findings: DataFrame) -> DataFrame:
    """Warnings, errors and whether the table passed (no errors): one row."""
    return findings.agg(
        F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "error").alias("errors")
    ).withColumn("passed", F.col("errors") == 0)
