"""Equi-joins that stay balanced when keys are missing or hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALT = "__salt"


def row_salt(df: DataFrame, width: int) -> Column:
    """Repeatable salt in [0, width): a hash of the row, so a retried task sends each row to the same place."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.pmod(F.xxhash64(*plain), F.lit(width)).cast("int")


def spread_width(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def salt_width(df: DataFrame) -> int:
    """Several salts per shuffle partition, so that hashing spreads them evenly."""
    return 4 * spread_width(df)


def attach(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join onto a reference table, with NULL keys spread over the cluster.

    A left outer shuffle join sends all NULL keys to one task although none of them can match. Here they carry a row
    salt that the right side never has, so they scatter. Hot known keys are left to AQE, which can split them because
    both sides of the join sit directly on a shuffle.
    """
    keys = [on] if isinstance(on, str) else list(on)
    missing = F.col(keys[0]).isNull()
    for key in keys[1:]:
        missing = missing | F.col(key).isNull()
    salted = left.withColumn(_SALT, F.when(missing, row_salt(left, salt_width(left)) + 1).otherwise(0))
    target = right.withColumn(_SALT, F.lit(0))
    return salted.join(target, [*keys, _SALT], "left").drop(_SALT)


def join_growth(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """What a left join of a many-to-many key would make, from key counts alone: one row.

    ``left_rows, joined_rows, matched_keys, hottest_key, hottest_rows``. Both sides collapse to one row per key map-side, and
    those meet; the join itself is not run. Of equally hot keys the greatest is named. NULL keys match nothing but stay.
    """
    ours = left.groupBy(on).agg(F.count(F.lit(1)).alias("_left"))
    theirs = right.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_right"))
    met = attach(ours, theirs, on).withColumn("_rows", F.col("_left") * F.greatest(F.coalesce("_right", F.lit(0)), F.lit(1)))
    hottest = F.max(F.when(F.col("_right").isNotNull(), F.struct("_rows", on)))
    return met.agg(
        F.coalesce(F.sum("_left"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("joined_rows"),
        F.count("_right").alias("matched_keys"),
        hottest[on].alias("hottest_key"),
        hottest["_rows"].alias("hottest_rows"),
    )


def keep_listed(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Membership filter against an id table (a semi join, so the list never passes through the driver)."""
    return df.join(ids.select(on), on, "left_semi")


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer partitions than the cluster has slots, before heavy per-row work.

    One gzip file, or one Parquet row group, is one task however large the cluster is. A scan with enough partitions is
    left as it is, so tables of many files never pay for the shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)
