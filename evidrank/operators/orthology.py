"""Animal-model layer: best-supported ortholog, keyword-filtered phenotypes, weighted score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.functions.joins import attach, keep_listed
from evidrank.functions.rows import clip, contains_any, filled_sum, join_known, ladder, list_length, log2_plus_one, lookup
from evidrank.sources.schema import empty_like, find_column

# Support cut-offs, confidence weights and source weights.
HIGH_SUPPORT, MEDIUM_SUPPORT = 8, 4
CONFIDENCE_WEIGHTS = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4}
MOUSE_WEIGHT, FISH_WEIGHT, CONFIRMED_WEIGHT = 0.4, 0.3, 0.3

PHENOTYPE_SCHEMA = "{entity} string, {term_id} string, {term} string"


def best_support(
    df: DataFrame,
    entity: str,
    candidate: str,
    support_count: str,
    prefix: str,
    high: int = HIGH_SUPPORT,
    medium: int = MEDIUM_SUPPORT,
) -> DataFrame:
    """Best-supported candidate per entity and its confidence; equal support falls to the smallest candidate name.

    One ``min`` over (-support, candidate) combines map-side, so a hot entity never gathers in one task.
    """
    best = df.groupBy(entity).agg(F.min(F.struct((-F.col(support_count)).alias("s"), F.col(candidate).alias("c"))).alias("b"))
    support = -F.col("b.s")
    confidence = ladder([(support >= high, "HIGH"), (support >= medium, "MEDIUM")], "LOW")
    return best.select(entity, F.col("b.c").alias(f"{prefix}_ortholog"), confidence.alias(f"{prefix}_ortholog_confidence"))


def ortholog_table(raw: DataFrame, symbol_column: str, prefix: str, ids: DataFrame | None = None) -> DataFrame:
    """Best ortholog per entity from a source with a comma-separated ``support`` list; empty without its columns."""
    if symbol_column not in raw.columns:
        return empty_like(raw, f"gene_id string, {prefix}_ortholog string, {prefix}_ortholog_confidence string")
    rows = raw.select(
        F.col("human_ensembl_gene").alias("gene_id"),
        F.col(symbol_column).alias("candidate"),
        list_length("support").alias("support_count"),
    )
    rows = rows if ids is None else keep_listed(rows, ids, "gene_id")
    return best_support(rows, "gene_id", "candidate", "support_count", prefix)


def ortholog_mapping(ids: DataFrame, mouse: DataFrame, fish: DataFrame) -> DataFrame:
    """Requested ids left-joined to the best ortholog of each species."""
    return attach(attach(ids.select("gene_id"), mouse, "gene_id"), fish, "gene_id")


def marker_phenotypes(raw: DataFrame, term_column: str | None = None) -> DataFrame:
    """Phenotype rows of the marker report, columns found by name; empty when the report lacks them.

    The report itself has no term names; ``term_column`` names the column of a joined-in vocabulary.
    """
    marker = find_column(raw.columns, all_of=["marker", "symbol"], pick="last")
    rest = [c for c in raw.columns if c != marker]
    term_id = find_column(rest, any_of=["mammalian phenotype id", "mp id"], pick="last")
    schema = PHENOTYPE_SCHEMA.format(entity="mouse_gene", term_id="mp_term_id", term="mp_term_name")
    if marker is None or term_id is None:
        return empty_like(raw, schema)
    name = F.col(f"`{term_column}`") if term_column else F.lit(None).cast("string")
    return raw.select(
        F.col(f"`{marker}`").alias("mouse_gene"), F.col(f"`{term_id}`").alias("mp_term_id"), name.alias("mp_term_name")
    ).distinct()


def structure_phenotypes(raw: DataFrame) -> DataFrame:
    """Phenotype rows of the affected-structure report; the first phenotype-like column gives the term."""
    schema = PHENOTYPE_SCHEMA.format(entity="zebrafish_gene", term_id="zp_term_id", term="zp_term_name")
    genes = [c for c in raw.columns if find_column([c], all_of=["gene"], any_of=["symbol", "name"])]
    gene = genes[-1] if genes else None
    term = find_column([c for c in raw.columns if c not in genes], any_of=["phenotype", "structure", "process"])
    if gene is None or term is None:
        return empty_like(raw, schema)
    return raw.select(
        F.col(f"`{gene}`").alias("zebrafish_gene"),
        F.lit(None).cast("string").alias("zp_term_id"),
        F.col(f"`{term}`").alias("zp_term_name"),
    ).distinct()


def keyword_filter(df: DataFrame, keywords: Sequence[str], term: str) -> DataFrame:
    """Rows whose term contains any keyword, ignoring case; a missing column leaves nothing."""
    if term not in df.columns:
        return df.where(F.lit(False))
    return df.where(contains_any(term, keywords))


def term_counts(df: DataFrame, entity: str, term: str, prefix: str) -> DataFrame:
    """Number of phenotype rows per entity and its terms as a run-length coded list of (term, n), sorted by term.

    Rows collapse to (entity, term, count) map-side, and a term stands once in the list however many rows hold it: what
    gathers per entity, in rows and in bytes, is bounded by the vocabulary. ``term_pieces`` writes the list out.
    """
    per_term = df.where(F.col(term).isNotNull()).groupBy(entity, term).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.sort_array(F.collect_list(F.struct(F.col(term).alias("term"), F.col("_n").alias("n"))))
    return per_term.groupBy(entity).agg(F.sum("_n").alias(f"{prefix}_phenotype_count"), pairs.alias(f"{prefix}_term_counts"))


def term_pieces(coded: DataFrame, entity: str, prefix: str, separator: str = "; ", repeats: int = 10_000) -> DataFrame:
    """A coded list written out for a sink: ``entity, piece, terms``, each piece at most ``repeats`` times one term.

    Pieces in order, joined by the separator, are the whole string; no task ever holds more than one piece of it.
    """
    rows = coded.select(entity, F.posexplode(f"{prefix}_term_counts").alias("_at", "_t"))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_t.n") - 1) / repeats))
    rows = rows.select(entity, "_at", "_t", F.explode(parts).alias("_part"))
    times = F.least(F.lit(repeats).cast("long"), F.col("_t.n") - F.col("_part") * repeats).cast("int")
    piece = F.concat(F.expr(f"repeat(concat(_t.term, {_text(separator)}), cast(least({repeats}L, _t.n - _part * {repeats}) as int) - 1)"), F.col("_t.term"))
    return rows.select(entity, F.struct(F.col("_at").alias("term"), F.col("_part").alias("part")).alias("piece"), times.alias("n"), piece.alias("terms"))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def term_rollup(df: DataFrame, entity: str, term: str, prefix: str, separator: str = "; ") -> DataFrame:
    """Number of phenotype rows per entity and their terms as one sorted string, a term on several rows repeated.

    The coded list is gathered (``term_counts``); only its row is written out, so the string is as long as its terms
    and rows make it. For entities with very many rows take ``term_counts`` and ``term_pieces``.
    """
    coded = term_counts(df, entity, term, prefix)
    listed = F.flatten(F.transform(f"{prefix}_term_counts", lambda p: F.array_repeat(p["term"], p["n"].cast("int"))))
    return coded.select(entity, f"{prefix}_phenotype_count", F.array_join(listed, separator).alias(f"{prefix}_terms"))


def animal_score(df: DataFrame) -> DataFrame:
    """Add ``animal_model_score_normalized``; NULL exactly when neither species has an ortholog.

    The weighted sum over sources is scaled by log2(count + 1) over its largest value in the table; a missing count
    scales to zero.
    """
    weight = lambda c: lookup(c, CONFIDENCE_WEIGHTS, 0.0)
    base = (
        F.when(F.col("has_mouse_phenotype"), MOUSE_WEIGHT * weight("mouse_ortholog_confidence")).otherwise(0.0)
        + F.when(F.col("has_zebrafish_phenotype"), FISH_WEIGHT * weight("zebrafish_ortholog_confidence")).otherwise(0.0)
        + F.when(F.col("has_impc_phenotype"), CONFIRMED_WEIGHT).otherwise(0.0)
    )
    top = df.agg(F.coalesce(F.nullif(F.max("sensory_phenotype_count"), F.lit(0)), F.lit(1))).scalar()
    scale = F.coalesce(log2_plus_one("sensory_phenotype_count") / log2_plus_one(top), F.lit(0.0))
    mapped = F.col("mouse_ortholog").isNotNull() | F.col("zebrafish_ortholog").isNotNull()
    return df.withColumn("animal_model_score_normalized", F.when(mapped, clip(base * scale)))


def animal_layer(
    orthologs: DataFrame,
    mouse: DataFrame,
    fish: DataFrame,
    confirmed: DataFrame,
    mouse_keywords: Sequence[str],
    fish_keywords: Sequence[str],
    max_p_value: float | None = None,
) -> DataFrame:
    """Keyword-filter three phenotype sources, roll them up per gene, join over the orthologs and score."""
    if max_p_value is not None:
        confirmed = confirmed.where(F.col("p_value") <= max_p_value)
    sources = [
        (mouse, mouse_keywords, "mouse_gene", "mp_term_name", "mgi", "mouse_ortholog"),
        (fish, fish_keywords, "zebrafish_gene", "zp_term_name", "zfin", "zebrafish_ortholog"),
        (confirmed, mouse_keywords, "mouse_gene", "mp_term_name", "impc", "mouse_ortholog"),
    ]
    out = orthologs
    for rows, keywords, entity, term, prefix, key in sources:
        rolled = term_rollup(keyword_filter(rows, keywords, term), entity, term, prefix)
        out = attach(out, rolled.withColumnRenamed(entity, key), key)
    counts = ["mgi_phenotype_count", "zfin_phenotype_count", "impc_phenotype_count"]
    out = out.select(
        *orthologs.columns,
        (F.col(counts[0]) > 0).alias("has_mouse_phenotype"),
        (F.col(counts[1]) > 0).alias("has_zebrafish_phenotype"),
        (F.col(counts[2]) > 0).alias("has_impc_phenotype"),
        F.nullif(filled_sum(counts), F.lit(0)).alias("sensory_phenotype_count"),
        F.coalesce(join_known(["mgi_terms", "zfin_terms", "impc_terms"], "; "), F.lit("")).alias("phenotype_categories"),
    )
    return animal_score(out)


def animal_summary(df: DataFrame) -> DataFrame:
    level = lambda species, c: F.count_if(F.col(f"{species}_ortholog_confidence") == c)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("mouse_ortholog").alias("with_mouse_count"),
        F.count("zebrafish_ortholog").alias("with_zebrafish_count"),
        F.count("sensory_phenotype_count").alias("with_sensory_count"),
        *[level(s, c).alias(f"{s}_{c.lower()}_count") for s in ("mouse", "zebrafish") for c in CONFIDENCE_WEIGHTS],
        F.coalesce(F.avg("sensory_phenotype_count"), F.lit(0.0)).alias("mean_sensory_count"),
    )


def animal_supported(df: DataFrame, at_least: float = 0.3) -> DataFrame:
    """Rows with a score at or over the threshold, highest first."""
    return (
        df.where(F.col("animal_model_score_normalized") >= at_least)
        .select(
            "gene_id",
            "mouse_ortholog",
            "zebrafish_ortholog",
            "sensory_phenotype_count",
            "phenotype_categories",
            "animal_model_score_normalized",
        )
        .orderBy(F.desc("animal_model_score_normalized"), "gene_id")
    )
