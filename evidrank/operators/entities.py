"""Entity universe, identifier mapping report and the two input gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.functions.joins import attach
from evidrank.functions.rows import ladder

# Allowed universe size, and mapping success limits.
MIN_ENTITIES, MAX_ENTITIES = 19_000, 23_000
FAIL_BELOW, WARN_BELOW = 0.90, 0.95


def map_requested(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every requested id with its symbol and accession; ids without a mapping keep NULLs."""
    return attach(ids.select("gene_id"), mapping, "gene_id")


def mapping_report(mapped: DataFrame) -> DataFrame:
    """One row: requested, mapped to a symbol, mapped to an accession, and both rates (0 for an empty request)."""
    counts = mapped.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("gene_symbol").alias("mapped_symbol"),
        F.count("uniprot_accession").alias("mapped_accession"),
    )
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0))
    return counts.withColumns({"symbol_rate": rate("mapped_symbol"), "accession_rate": rate("mapped_accession")})


def unmapped_ids(mapped: DataFrame) -> DataFrame:
    return mapped.where(F.col("gene_symbol").isNull()).select("gene_id")


def mapping_gate(report: DataFrame, fail_below: float = FAIL_BELOW, warn_below: float = WARN_BELOW) -> DataFrame:
    """Add ``status`` (failed, warning, passed) and ``passed`` by the symbol rate; the accession rate only informs."""
    rate = F.col("symbol_rate")
    status = ladder([(rate < fail_below, "failed"), (rate < warn_below, "warning")], "passed")
    return report.withColumn("status", status).withColumn("passed", F.col("status") != "failed")


def universe_gate(
    universe: DataFrame,
    prefix: str = "ENSG",
    low: int = MIN_ENTITIES,
    high: int = MAX_ENTITIES,
    entity: str = "gene_id",
) -> DataFrame:
    """One row: size, ids without the prefix, surplus duplicates, one flag per check, and whether all passed.

    Duplicates come from per-id counts combined map-side, not from one distinct set in a single task.
    """
    per_id = universe.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    counts = per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(~F.col(entity).startswith(prefix), F.col("_n"))), F.lit(0)).alias("bad_prefix"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    )
    checks = {
        "size_ok": F.col("total").between(low, high),
        "prefix_ok": F.col("bad_prefix") == 0,
        "unique_ok": F.col("duplicates") == 0,
    }
    return counts.withColumns(checks).withColumn(
        "passed", F.col("size_ok") & F.col("prefix_ok") & F.col("unique_ok")
    )
