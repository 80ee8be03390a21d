"""Localization layer: membership flags, evidence type and proximity score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.functions.joins import attach, keep_listed
from evidrank.functions.rows import as_col, contains_any, join_known, ladder

# Reliability classes, compartment substrings, proximity scores and evidence weights.
EXPERIMENTAL_LEVELS = ("Enhanced", "Supported")
COMPUTATIONAL_LEVELS = ("Approved", "Uncertain")
COMPARTMENTS = {
    "compartment_cilia": ["cili"],
    "compartment_centrosome": ["centrosome", "centriole"],
    "compartment_basal_body": ["basal body"],
    "compartment_transition_zone": ["transition zone"],
    "compartment_stereocilia": ["stereocili"],
}
ADJACENT = ["cytoskeleton", "microtubule", "cell junction", "focal adhesion"]
DIRECT_SCORE, ADJACENT_SCORE, MEMBER_SCORE, OTHER_SCORE = 1.0, 0.5, 0.3, 0.0
COMPUTATIONAL_WEIGHT = 0.6


def location_strings(
    raw: DataFrame,
    symbol: str = "Gene name",
    reliability: str = "Reliability",
    parts: Sequence[str] = ("Main location", "Additional location", "Extracellular location"),
) -> DataFrame:
    """One ``;``-joined location string per source row; no location at all is NULL, not an empty string."""
    return raw.select(
        F.col(f"`{symbol}`").alias("gene_symbol"),
        F.col(f"`{reliability}`").alias("hpa_reliability"),
        join_known([F.col(f"`{p}`") for p in parts], ";").alias("hpa_main_location"),
    )


def membership_flags(df: DataFrame, sets: Mapping[str, DataFrame], on: str = "gene_symbol") -> DataFrame:
    """Add one flag per set table: TRUE for members, FALSE (never NULL) for the rest.

    The sets become one table of flags, so any number of them costs one join.
    """
    tagged = None
    for flag, members in sets.items():
        part = members.select(on, F.lit(flag).alias("_set"))
        tagged = part if tagged is None else tagged.unionByName(part)
    flags = tagged.groupBy(on).agg(*[F.max(F.col("_set") == flag).alias(flag) for flag in sets])
    return attach(df, flags, on).withColumns({flag: F.coalesce(flag, F.lit(False)) for flag in sets})


def evidence_type(df: DataFrame, members: Sequence[str] = ("in_cilia_proteomics", "in_centrosome_proteomics")) -> DataFrame:
    """Add ``hpa_evidence_type`` and ``evidence_type`` (experimental, computational, both, none)."""
    level = F.col("hpa_reliability")
    own = ladder(
        [
            (level.isin(*EXPERIMENTAL_LEVELS), "experimental"),
            (level.isin(*COMPUTATIONAL_LEVELS), "computational"),
        ],
        F.lit(None).cast("string"),
    )
    df = df.withColumn("hpa_evidence_type", own)
    member = _is_member(members)
    kind = F.col("hpa_evidence_type")
    merged = ladder(
        [
            (member & (kind == "computational"), "both"),
            (member, "experimental"),
            (kind.isNotNull(), kind),
        ],
        "none",
    )
    return df.withColumn("evidence_type", merged)


def _is_member(members: Sequence[str]):
    return F.greatest(*[F.coalesce(as_col(m), F.lit(False)) for m in members], F.lit(False))


def proximity_score(
    df: DataFrame,
    compartments: Mapping[str, Sequence[str]] = COMPARTMENTS,
    adjacent: Sequence[str] = tuple(ADJACENT),
    members: Sequence[str] = ("in_cilia_proteomics", "in_centrosome_proteomics"),
) -> DataFrame:
    """Add compartment flags, ``cilia_proximity_score`` and the evidence-weighted ``localization_score_normalized``."""
    place = F.col("hpa_main_location")
    df = df.withColumns({flag: contains_any(place, words) for flag, words in compartments.items()})
    direct = F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in compartments], F.lit(False))
    member = _is_member(members)
    score = ladder(
        [
            (direct, DIRECT_SCORE),
            (contains_any(place, adjacent), ADJACENT_SCORE),
            (member & place.isNull(), MEMBER_SCORE),
            (member | place.isNotNull(), OTHER_SCORE),
        ],
        F.lit(None).cast("double"),
    )
    df = df.withColumn("cilia_proximity_score", score)
    kind, base = F.col("evidence_type"), F.col("cilia_proximity_score")
    weighted = F.when(kind == "computational", base * COMPUTATIONAL_WEIGHT).when(kind != "none", base)
    return df.withColumn("localization_score_normalized", weighted)


def localization_layer(symbol_map: DataFrame, locations: DataFrame, sets: Mapping[str, DataFrame], ids: DataFrame) -> DataFrame:
    """Requested entities with their location rows (over the symbol map) and set memberships, classified and scored."""
    wanted = keep_listed(symbol_map.select("gene_id", "gene_symbol"), ids, "gene_id")
    located = locations.join(wanted, "gene_symbol").select("gene_id", "hpa_main_location", "hpa_reliability")
    flagged = membership_flags(attach(wanted, located, "gene_id"), sets)
    members = list(sets)
    return proximity_score(evidence_type(flagged, members), members=members)


def localization_summary(df: DataFrame) -> DataFrame:
    kind = F.col("evidence_type")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(kind == "experimental").alias("experimental_count"),
        F.count_if(kind == "computational").alias("computational_count"),
        F.count_if(kind == "both").alias("both_count"),
        F.count_if(kind == "none").alias("none_count"),
        F.count_if(F.col("compartment_cilia") | F.col("compartment_centrosome")).alias("cilia_compartment_count"),
        F.count_if(F.col("cilia_proximity_score") > 0.5).alias("high_proximity_count"),
        F.avg("localization_score_normalized").alias("mean_localization_score"),
    )


def localized_entities(df: DataFrame, above: float = 0.5) -> DataFrame:
    """Rows over the proximity threshold, best weighted score first."""
    return (
        df.where(F.col("cilia_proximity_score") > above)
        .select(
            "gene_id",
            "gene_symbol",
            "evidence_type",
            "compartment_cilia",
            "compartment_centrosome",
            "compartment_basal_body",
            "in_cilia_proteomics",
            "in_centrosome_proteomics",
            "cilia_proximity_score",
            "localization_score_normalized",
        )
        .orderBy(F.desc("localization_score_normalized"), F.desc("cilia_proximity_score"), "gene_id")
    )
