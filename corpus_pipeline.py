"""A corpus pipeline of five stages over ``documents``: clean, deduplicate, mask, mix and pack.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its rows are written as Parquet
and read again as the next one's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrank.llm import minhash, mixing, packing, secret_scan, simhash, toxicity
from evidrank.llm.common import settled, table
from evidrank.llm.queries import packing_parameters


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled rows among ``docs`` and drop the documents that score 0.5 or more."""
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, weights, out="_toxicity")
    # By place, as the documents may have a column of that name too.
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = scored.toDF(*names, "score").where(F.col("score") < 0.5)
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-duplicates the row with the smallest id, once; rows without an id come last.

    Groups are those of the SimHash operator over five words, joined further where MinHash leaders show a Jaccard
    similarity of 0.8 or more, which SimHash alone mostly misses below 0.95. NULL and empty texts are one group.
    """
    read = docs.select("doc_id", "text")
    groups = simhash.near_duplicates(read, width=5)
    return simhash.first_of_each(docs, minhash.near_copies(read, simhash.text_links(groups)))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts; n_chars follows. No document is dropped and clean ones stay as they are."""
    rows = secret_scan.mask(docs)
    return rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else rows


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents until each source has its share of the words."""
    return mixing.copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset, padded.

    Workers remember fewer words than in packing alone, as the stages before leave the executors' heaps full.
    """
    return packing.pack(docs, replace(packing_parameters(), memory=150_000))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither XXH64 nor a tokenizer, so the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
