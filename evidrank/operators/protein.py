"""Protein feature layer: merged domain lists, motif flags and weighted feature score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.functions.joins import attach, keep_listed
from evidrank.functions.ranks import with_percentile
from evidrank.functions.rows import any_element_contains, union_distinct

# Weights and the cap on the region count.
LENGTH_WEIGHT, DOMAIN_WEIGHT, COIL_WEIGHT, REGION_WEIGHT, MOTIF_WEIGHT, SCAFFOLD_WEIGHT = 0.15, 0.20, 0.20, 0.20, 0.15, 0.10
REGION_CAP = 20


def merge_features(features: DataFrame, domains: DataFrame) -> DataFrame:
    """Union of both sources' domain names per entry, their number, and the three-valued coiled-coil flag."""
    other = domains.select("uniprot_id", F.col("domain_names").alias("_other_names"))
    both = attach(features, other, "uniprot_id").withColumn("domain_names", union_distinct("domain_names", "_other_names"))
    size = F.when(F.col("domain_names").isNotNull(), F.size("domain_names").cast("long"))
    return both.select(
        "uniprot_id",
        "protein_length",
        size.alias("domain_count"),
        (F.col("coiled_coil_count") > 0).alias("coiled_coil"),
        "coiled_coil_count",
        "transmembrane_count",
        "domain_names",
    )


def motif_flags(df: DataFrame, groups: Mapping[str, Sequence[str]], names: str = "domain_names") -> DataFrame:
    """Add one three-valued flag per keyword group; NULL for a missing or empty list."""
    return df.withColumns({flag: any_element_contains(names, words) for flag, words in groups.items()})


def protein_score(df: DataFrame) -> DataFrame:
    """Add ``protein_score_normalized``; NULL exactly when the length is unknown.

    Both rank parts are taken among rows of known length, on both sides of the division, so neither can pass 1.
    """
    known = F.col("protein_length").isNotNull()
    ranked = with_percentile(
        df.withColumns(
            {"_length": F.col("protein_length").cast("double"), "_domains": F.when(known, F.col("domain_count").cast("double"))}
        ),
        {"_length_rank": "_length", "_domain_rank": "_domains"},
        over="max",
    )
    zero = F.lit(0.0)
    flag = lambda c: F.coalesce(F.col(c).cast("double"), zero)
    score = (
        LENGTH_WEIGHT * F.coalesce("_length_rank", zero)
        + DOMAIN_WEIGHT * F.coalesce("_domain_rank", zero)
        + COIL_WEIGHT * flag("coiled_coil")
        + REGION_WEIGHT * F.coalesce(F.least("transmembrane_count", F.lit(REGION_CAP)) / F.lit(float(REGION_CAP)), zero)
        + MOTIF_WEIGHT * flag("has_cilia_domain")
        + SCAFFOLD_WEIGHT * flag("scaffold_adaptor_domain")
    )
    return ranked.withColumn("protein_score_normalized", F.when(known, score)).drop(
        "_length", "_domains", "_length_rank", "_domain_rank"
    )


def protein_layer(
    symbol_map: DataFrame, features: DataFrame, domains: DataFrame, groups: Mapping[str, Sequence[str]], ids: DataFrame
) -> DataFrame:
    """Merge, flag and score per accession, then return to every requested entity, with or without an accession."""
    wanted = keep_listed(symbol_map.select("gene_id", "gene_symbol", "uniprot_id"), ids, "gene_id")
    accessions = wanted.select("uniprot_id").where(F.col("uniprot_id").isNotNull()).distinct()
    scored = protein_score(motif_flags(merge_features(keep_listed(features, accessions, "uniprot_id"), domains), groups))
    return attach(wanted, scored, "uniprot_id").select(
        "gene_id",
        "gene_symbol",
        "uniprot_id",
        "protein_length",
        "domain_count",
        "coiled_coil",
        "coiled_coil_count",
        "transmembrane_count",
        *groups,
        "protein_score_normalized",
    )


def protein_summary(df: DataFrame) -> DataFrame:
    true = lambda c: F.count_if(F.col(c))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("uniprot_id").alias("with_uniprot_count"),
        F.count_if(F.col("uniprot_id").isNull()).alias("null_uniprot_count"),
        true("has_cilia_domain").alias("cilia_domain_count"),
        true("scaffold_adaptor_domain").alias("scaffold_domain_count"),
        true("coiled_coil").alias("coiled_coil_count"),
        F.count_if(F.col("transmembrane_count") > 0).alias("tm_domain_count"),
        F.round(F.avg("domain_count"), 2).alias("mean_domain_count"),
    )


def motif_candidates(df: DataFrame) -> DataFrame:
    """Rows with the motif, or with both a coiled coil and a scaffold domain; best score first."""
    return df.where(
        F.col("has_cilia_domain") | (F.col("coiled_coil") & F.col("scaffold_adaptor_domain"))
    ).orderBy(F.desc_nulls_last("protein_score_normalized"), "gene_id")
