"""Constraint layer: coverage flag, inverted min-max score, id rescue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.functions.joins import attach
from evidrank.functions.rows import ladder
from evidrank.sources.schema import lenient, resolve_aliases

# Header names the constraint source has used across versions, per target column.
COLUMN_VARIANTS = {
    "gene_id": ["gene_id"],
    "gene_symbol": ["gene", "gene_symbol"],
    "transcript": ["transcript", "canonical_transcript", "mane_select"],
    "pli": ["pLI", "lof.pLI", "pli"],
    "loeuf": ["lof.oe_ci.upper", "oe_lof_upper", "oe_lof", "loeuf"],
    "loeuf_upper": ["lof.oe_ci.upper", "oe_lof_upper_ci", "oe_lof_upper"],
    "mean_depth": ["mean_coverage", "mean_depth", "mean_cov"],
    "cds_covered_pct": ["mean_proportion_covered_bases", "mean_proportion_covered", "cds_covered_pct"],
}


def constraint_columns(raw: DataFrame) -> DataFrame:
    """Source columns under their target names, whatever version the header comes from."""
    return resolve_aliases(raw, COLUMN_VARIANTS, twins=[("loeuf", "loeuf_upper")])


def flag_coverage(df: DataFrame, min_depth: float = 30.0, min_covered: float = 0.9) -> DataFrame:
    """Add ``quality_flag``: measured, incomplete_coverage or no_data. Keeps every row.

    Without the two coverage columns a known value alone makes a row measured.
    """
    covered = {"mean_depth", "cds_covered_pct"} <= set(df.columns)
    numeric = ["loeuf", "pli"] + (["mean_depth", "cds_covered_pct"] if covered else [])
    df = df.withColumns({c: lenient(c, "double") for c in numeric})
    measured = F.col("loeuf").isNotNull()
    if covered:
        measured = measured & (F.col("mean_depth") >= min_depth) & (F.col("cds_covered_pct") >= min_covered)
    nothing = F.col("loeuf").isNull() & F.col("pli").isNull()
    return df.withColumn("quality_flag", ladder([(measured, "measured"), (nothing, "no_data")], "incomplete_coverage"))


def invert_minmax(df: DataFrame) -> DataFrame:
    """Add ``loeuf_normalized`` = (max - x) / (max - min) over measured rows; NULL elsewhere or without spread.

    Minimum and maximum are one scalar subquery, so the plan stays lazy and has no join.
    """
    is_measured = F.col("quality_flag") == "measured"
    span = df.where(is_measured).agg(F.struct(F.min("loeuf").alias("lo"), F.max("loeuf").alias("hi")))
    lo, hi = span.scalar()["lo"], span.scalar()["hi"]
    score = F.try_divide(hi - F.col("loeuf"), F.nullif(hi - lo, F.lit(0.0)))
    return df.withColumn("loeuf_normalized", F.when(is_measured, score))


def rescue_ids(df: DataFrame, universe: DataFrame, prefix: str = "ENSG") -> DataFrame:
    """Keep ids with the valid prefix, replace the others by the id the universe holds for the symbol.

    Without an id column the id always comes from the symbol. A symbol with several ids fans out, as in any map join.
    """
    ids = universe.select(F.col("gene_id").alias("_mapped_id"), "gene_symbol")
    joined = attach(df, ids, "gene_symbol")
    if "gene_id" not in df.columns:
        return joined.withColumnRenamed("_mapped_id", "gene_id")
    own = F.col("gene_id")
    return joined.withColumn("gene_id", F.when(own.startswith(prefix), own).otherwise(F.col("_mapped_id"))).drop(
        "_mapped_id"
    )


def constraint_layer(
    raw: DataFrame, universe: DataFrame | None = None, min_depth: float = 30.0, min_covered: float = 0.9, prefix: str = "ENSG"
) -> DataFrame:
    """Header aliases -> coverage flag -> score -> (with a universe) id rescue."""
    scored = invert_minmax(flag_coverage(constraint_columns(raw), min_depth, min_covered))
    return scored if universe is None else rescue_ids(scored, universe, prefix)


def constraint_summary(df: DataFrame) -> DataFrame:
    flag = F.col("quality_flag")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(flag == "measured").alias("measured_count"),
        F.count_if(flag == "incomplete_coverage").alias("incomplete_count"),
        F.count_if(flag == "no_data").alias("no_data_count"),
        F.count_if(F.col("loeuf").isNull()).alias("null_loeuf_count"),
    )


def constrained_entities(df: DataFrame, below: float = 0.6) -> DataFrame:
    """Measured rows under the threshold, lowest value first."""
    return (
        df.where((F.col("quality_flag") == "measured") & (F.col("loeuf") < below))
        .select("gene_id", "gene_symbol", "loeuf", "pli", "quality_flag", "loeuf_normalized")
        .orderBy("loeuf", "gene_id")
    )
