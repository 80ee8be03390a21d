"""Literature layer: context mention counts over a document table, evidence tier and bias-corrected score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.functions.joins import attach, keep_listed
from evidrank.functions.ranks import with_percentile
from evidrank.functions.rows import filled_sum, ladder, lookup, may_hold, membership_sketch, mentions_any
from evidrank.sources.stages import resume_remaining

# Tier and context weights, and the tier order the query helper follows.
TIER_WEIGHTS = {"direct_experimental": 1.0, "functional_mention": 0.6, "hts_hit": 0.3, "incidental": 0.1, "none": 0.0}
CONTEXT_WEIGHTS = {
    "cilia_context_count": 2.0,
    "sensory_context_count": 2.0,
    "cytoskeleton_context_count": 1.0,
    "cell_polarity_context_count": 1.0,
}
TIER_ORDER = {"direct_experimental": 0, "functional_mention": 1, "hts_hit": 2, "incidental": 3, "none": 4}


def document_flags(
    docs: DataFrame, contexts: Mapping[str, Sequence[str]], direct: Sequence[str], screen: Sequence[str], text: str = "text"
) -> DataFrame:
    """Add one flag per context, plus direct evidence (within the first context) and screen flags.

    The whole text of a document is read once, whatever the number of entities it mentions.
    """
    flags = {f"{name}_context": mentions_any(text, terms) for name, terms in contexts.items()}
    first = f"{next(iter(contexts))}_context"
    df = docs.withColumns({**flags, "hts_screen": mentions_any(text, screen), "_direct": mentions_any(text, direct)})
    return df.withColumn("direct_experimental", F.col("_direct") & F.col(first)).drop("_direct")


def _counts(flags: Sequence[str]):
    return [F.count(F.lit(1)).alias("total_pubmed_count"), *[F.count_if(F.col(f)).alias(f"{f}_count") for f in flags]]


def context_counts(
    docs: DataFrame,
    entity: str,
    contexts: Mapping[str, Sequence[str]],
    direct: Sequence[str],
    screen: Sequence[str],
    text: str = "text",
) -> DataFrame:
    """Documents per entity in total and per flag, for documents that already carry their entity."""
    flagged = document_flags(docs, contexts, direct, screen, text)
    flags = [*[f"{n}_context" for n in contexts], "direct_experimental", "hts_screen"]
    return flagged.groupBy(entity).agg(*_counts(flags))


def mention_counts(
    docs: DataFrame,
    entities: DataFrame,
    contexts: Mapping[str, Sequence[str]],
    direct: Sequence[str],
    screen: Sequence[str],
    text: str = "text",
    symbol: str = "gene_symbol",
) -> DataFrame:
    """Documents that mention each entity's symbol, in total and per flag; zero when never mentioned.

    A symbol of several words (``AC01.1``) is looked for as that run of words: symbols and texts are split by the same
    rule, and runs up to the longest symbol are taken from the texts. A sketch of all symbols, of fixed size, drops runs
    that are none before they become rows, so the rows follow the mentions and not the words. Distinct runs of each
    document are counted per run first, map-side, and only the totals meet the entity table. A word found in a third of all documents therefore
    costs one row per task, and the join has unique keys.
    """
    flagged = document_flags(docs, contexts, direct, screen, text)
    flags = [*[f"{n}_context" for n in contexts], "direct_experimental", "hts_screen"]
    split = lambda c: F.filter(F.split(F.lower(F.col(c)), "[^a-z0-9_-]+"), lambda w: w != "")
    listed = entities.select(symbol).distinct().withColumn("_words", split(symbol))
    lengths = sorted(r[0] for r in listed.select(F.size("_words")).distinct().collect() if r[0] > 0)  # one per length
    listed = listed.withColumn("_word", F.array_join("_words", " ")).drop("_words")

    def runs(words: Column, n: int) -> Column:
        if n == 1:
            return words
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: F.concat_ws(" ", F.slice(words, i + 1, F.lit(n))))

    worded = flagged.withColumn("_words", split(text))
    every = [runs(F.col("_words"), n) for n in lengths] or [F.array().cast("array<string>")]
    known = membership_sketch(listed, "_word")
    mentioned = F.array_distinct(F.filter(F.concat(*every), lambda w: may_hold(known, w)))
    found = worded.select(F.explode(mentioned).alias("_word"), *flags)
    per_word = found.groupBy("_word").agg(*_counts(flags))
    joined = attach(listed, per_word, "_word").drop("_word")
    return joined.na.fill(0, [c for c in joined.columns if c.endswith("_count")])


def literature_tier(df: DataFrame) -> DataFrame:
    """Add ``evidence_tier``; screen hits are tested before functional mentions."""
    at_least = lambda c, n: F.coalesce(F.col(c) >= n, F.lit(False))
    in_context = at_least("cilia_context_count", 1) | at_least("sensory_context_count", 1)
    tier = ladder(
        [
            (at_least("direct_experimental_count", 1) & in_context, "direct_experimental"),
            (at_least("hts_screen_count", 1) & in_context, "hts_hit"),
            (in_context & at_least("total_pubmed_count", 3), "functional_mention"),
            (at_least("total_pubmed_count", 1), "incidental"),
        ],
        "none",
    )
    return df.withColumn("evidence_tier", tier)


def literature_score(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Add ``literature_score_normalized``: tier-weighted context sum over log2(total + 1), as a rank percentile.

    NULL only for an unknown total. A total of zero scores raw 0 (the formula would be 0/0). ``digits`` rounds the raw
    score before ranking, so equal scores reached by different arithmetic tie.
    """
    context = filled_sum([F.col(c).cast("double") * w for c, w in CONTEXT_WEIGHTS.items()])
    total = F.col("total_pubmed_count")
    raw = context * lookup("evidence_tier", TIER_WEIGHTS, 0.0) / F.log2(F.greatest(total, F.lit(1)).cast("double") + 1)
    raw = F.when(total == 0, F.lit(0.0)).otherwise(raw)
    raw = raw if digits is None else F.round(raw, digits)
    ranked = with_percentile(df.withColumn("_raw", F.when(total.isNotNull(), raw)), {"literature_score_normalized": "_raw"})
    return ranked.drop("_raw")


def literature_layer(
    symbol_map: DataFrame, counts: DataFrame, ids: DataFrame, done: DataFrame | None = None, digits: int | None = None
) -> DataFrame:
    """Score each distinct symbol of the requested ids once, then join back to every id that carries it.

    ``done`` holds counts of an earlier partial run; they are kept, and only the other symbols are taken from
    ``counts``.
    """
    wanted = keep_listed(symbol_map.select("gene_id", "gene_symbol"), ids, "gene_id")
    symbols = wanted.select("gene_symbol").distinct()
    if done is not None:
        fresh = keep_listed(counts, resume_remaining(symbols, done, "gene_symbol"), "gene_symbol")
        counts = done.select(*counts.columns).unionByName(fresh)
    scored = literature_score(literature_tier(keep_listed(counts, symbols, "gene_symbol")), digits)
    return attach(wanted, scored, "gene_symbol")


def literature_summary(df: DataFrame) -> DataFrame:
    tier = F.col("evidence_tier")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(tier == t).alias(f"{t}_count") for t in TIER_ORDER],
        F.count_if(tier.isin("direct_experimental", "functional_mention", "hts_hit")).alias("with_evidence_count"),
        F.avg("literature_score_normalized").alias("mean_literature_score"),
    )


def supported_at_least(df: DataFrame, min_tier: str = "functional_mention") -> DataFrame:
    """Rows at or above a tier, best score first, unknown scores last."""
    if min_tier not in TIER_ORDER:
        raise ValueError(f"unknown tier {min_tier!r}; known: {', '.join(TIER_ORDER)}")
    allowed = [t for t, rank in TIER_ORDER.items() if rank <= TIER_ORDER[min_tier]]
    return df.where(F.col("evidence_tier").isin(*allowed)).orderBy(
        F.desc_nulls_last("literature_score_normalized"), "gene_id"
    )
