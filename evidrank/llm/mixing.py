"""Mixing sources to target weights: repetition rates per source, whole copies, and one Bernoulli copy per document.

A source's rate is its target over its size. Every document is taken floor(rate) times, and once more if its hash draw
falls below the fraction. The draw of a document depends on its id, its text and a seed only, so reruns agree. Plain
independent draws leave a source of a few uneven documents far from its target, so each source uses, of a fixed list
of seeds, the one whose draws bring it nearest to its target; the sums for all seeds come from the one aggregation.

NULL texts have size 0. NULL is a source of its own, the last one. Repeated rows draw alike: all take the extra copy
or none. A source without words has target 0. An empty table gives an empty mix. Other columns pass through ``copies``
untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrank.functions import ranks
from evidrank.llm.common import WORD, settled, whole_text

WEIGHTS = (5, 2, 1)
SHARE, MOST, SEEDS = 1.5, 2.0, 32


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def _draw(seed: Column | int) -> Column:
    """A number in [0, 1) from the row's id, its text key and the seed."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.pmod(F.xxhash64("_id", "_key", seed), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _keys() -> list[Column]:
    """What draws a document and finds its source; both are taken from the row alone."""
    return [F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole_text()).alias("_key"), F.col("source").alias("_source")]


def _reshared(sources: DataFrame, share: float, most: float) -> DataFrame:
    """target per source: weights share the total, and what would exceed ``most`` times a source is shared anew.

    The end of the resharing is min(most * size, level * weight) with one level for all; each round sends the three
    sums that give the next level to the driver, and a round without a newly full source is the last.
    """
    cap = F.col("source_size") * F.lit(most)
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = 0.0, -1
    if total:
        level = share * total / weights
        while True:
            over = cap <= F.lit(level) * F.col("weight")
            n, used, left = sources.agg(
                F.count_if(over), F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))
            ).first()
            if n == full or not left:
                break
            full, level = n, (share * total - used) / left
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def plan_mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seeds: int = SEEDS
) -> tuple[DataFrame, DataFrame]:
    """(sizes, rates): _id, _key, _source and size per document; size, target, rate and seed per source."""
    narrow = settled(docs.select(*_keys(), word_count(whole_text()).alias("size")))
    sources = narrow.groupBy("_source").agg(F.sum("size").alias("source_size"))
    numbered = ranks.with_row_number(sources, [F.col("_source").asc_nulls_last()], "_n")
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = settled(numbered.select("_source", "source_size", weight.alias("weight")))
    rates = _reshared(sources, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = settled(rates.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate")))
    drawn = narrow.join(rates.select("_source", "part"), narrow["_source"].eqNullSafe(rates["_source"])).drop(rates["_source"])
    sums = [F.sum(F.when(_draw(s) < F.col("part"), F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(seeds)]
    taken = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"s{s}").alias("extra")) for s in range(seeds)]))
    tried = drawn.groupBy("_source").agg(*sums).select(F.col("_source").alias("_of"), taken.alias("t"))
    tried = tried.join(rates, F.col("_of").eqNullSafe(F.col("_source")))
    off = F.abs(F.col("t.extra") - F.col("part") * F.col("source_size"))
    best = tried.groupBy("_source").agg(F.min(F.struct(off.alias("off"), F.col("t.seed").alias("seed"))).alias("best"))
    best = best.select(F.col("_source").alias("_of"), F.col("best.seed").alias("seed"))
    rates = rates.join(best, F.col("_of").eqNullSafe(F.col("_source")), "left").drop("_of")
    return narrow, settled(rates.select("_source", "source_size", "target", "rate", "whole", "part", "seed"))


def _with_copies(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """Each document with its source's row and ``copies``. A hot source is split by the join: both sides are scans."""
    rates = rates.select(*[F.col(c).alias("_rate_" + c.strip("_")) for c in rates.columns])
    joined = sized.join(rates, F.col("_source").eqNullSafe(F.col("_rate_source")))
    extra = F.when(_draw(F.col("_rate_seed")) < F.col("_rate_part"), 1).otherwise(0)
    return joined.withColumn("_copies", (F.col("_rate_whole") + extra).cast("int"))


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate, copies and taken (size times copies)."""
    rows = _with_copies(*plan_mix(docs, **options))
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.col("_source").alias("source"),
        "size",
        F.col("_rate_source_size").alias("source_size"),
        F.col("_rate_target").alias("target"),
        F.col("_rate_rate").alias("rate"),
        F.col("_copies").cast("long").alias("copies"),
        (F.col("size") * F.col("_copies")).alias("taken"),
    )


def copies(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    names = docs.columns
    renamed = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    _, rates = plan_mix(docs, **options)
    rows = _with_copies(docs.select(*renamed, *_keys()), rates)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return rows.withColumn("_one", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(*kept)
