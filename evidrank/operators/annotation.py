"""Annotation completeness layer: tier and weighted score from counts, a source score and a membership flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.functions.joins import attach, keep_listed
from evidrank.functions.ranks import quantiles
from evidrank.functions.rows import clip, known_sum, ladder, log2_plus_one
from evidrank.sources.stages import cut

# Tier cut-offs and component weights.
WELL_TERMS, WELL_SCORE = 20, 4
PARTIAL_TERMS, PARTIAL_SCORE = 5, 3
TERM_WEIGHT, SOURCE_WEIGHT, PATHWAY_WEIGHT, SOURCE_TOP = 0.5, 0.3, 0.2, 5.0


def annotation_tier(df: DataFrame) -> DataFrame:
    """Add ``annotation_tier``. Here, and only here, a missing count or score reads as zero."""
    terms = F.coalesce("go_term_count", F.lit(0))
    source = F.coalesce("uniprot_annotation_score", F.lit(0))
    well = (terms >= WELL_TERMS) & (source >= WELL_SCORE)
    partial = (terms >= PARTIAL_TERMS) | (source >= PARTIAL_SCORE)
    tier = ladder([(well, "well_annotated"), (partial, "partially_annotated")], "poorly_annotated")
    return df.withColumn("annotation_tier", tier)


def annotation_score(df: DataFrame) -> DataFrame:
    """Add ``annotation_score_normalized``: missing parts add nothing, all missing gives NULL, result in [0, 1]."""
    logs = log2_plus_one("go_term_count")
    top = df.agg(F.nullif(F.max(logs), F.lit(0.0))).scalar()
    parts = [
        logs / top * TERM_WEIGHT,
        F.col("uniprot_annotation_score") / F.lit(SOURCE_TOP) * SOURCE_WEIGHT,
        F.when(F.col("has_pathway_membership"), PATHWAY_WEIGHT).when(~F.col("has_pathway_membership"), 0.0),
    ]
    return df.withColumn("annotation_score_normalized", clip(known_sum(parts)))


def source_scores(mapping: DataFrame, scores: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Accession scores per entity: highest over its accessions, NULL for requested ids without one."""
    mapping = mapping.select("gene_id", "uniprot_accession")
    if ids is not None:
        mapping = keep_listed(mapping, ids, "gene_id")
    joined = attach(mapping, scores.select("uniprot_accession", "uniprot_annotation_score"), "uniprot_accession")
    best = joined.groupBy("gene_id").agg(F.max("uniprot_annotation_score").alias("uniprot_annotation_score"))
    return best if ids is None else attach(ids.select("gene_id"), best, "gene_id")


def annotation_layer(counts: DataFrame, mapping: DataFrame, scores: DataFrame) -> DataFrame:
    """Counts per entity, joined with their source scores, then tier and score."""
    joined = attach(counts, source_scores(mapping, scores), "gene_id")
    # The score reads the joined rows twice: once for the highest count, once for the result.
    return annotation_score(annotation_tier(cut(joined)))


def annotation_summary(df: DataFrame) -> DataFrame:
    tier, score = F.col("annotation_tier"), "annotation_score_normalized"
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(tier == "well_annotated").alias("well_annotated_count"),
        F.count_if(tier == "partially_annotated").alias("partially_annotated_count"),
        F.count_if(tier == "poorly_annotated").alias("poorly_annotated_count"),
        F.count_if(F.col("go_term_count").isNull()).alias("null_go_count"),
        F.count_if(F.col("uniprot_annotation_score").isNull()).alias("null_uniprot_count"),
        F.count_if(F.col(score).isNull()).alias("null_score_count"),
        F.avg(score).alias("mean_annotation_score"),
    )
    return counts.withColumn("median_annotation_score", quantiles(df, score, {"median": 0.5}).scalar())


def poorly_annotated(df: DataFrame, at_most: float = 0.3) -> DataFrame:
    """Known scores at or under the threshold, lowest first."""
    return (
        df.where(F.col("annotation_score_normalized") <= at_most)
        .select(
            "gene_id",
            "gene_symbol",
            "go_term_count",
            "uniprot_annotation_score",
            "has_pathway_membership",
            "annotation_tier",
            "annotation_score_normalized",
        )
        .orderBy("annotation_score_normalized", "gene_id")
    )
