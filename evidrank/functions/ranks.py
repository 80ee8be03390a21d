"""Global ranks, percentiles and row numbers without a single-task window.

A Spark window with no PARTITION BY pulls every row into one task. The helpers below never do that:

1. equal values collapse first (``groupBy(value).count()``, combined map-side), so a value that fills a third of the
   table costs one row per task;
2. the distinct values fall into buckets by a bounded list of quantile literals. Literals do not move between two
   evaluations of a plan, unlike sampled range partitions, and only balance depends on them, never the result;
3. running counts are taken inside a bucket, and the bucket totals (at most ``MAX_BUCKETS`` rows) are prefix-summed
   and broadcast;
4. ranks go back onto rows by an equi-join on the value, salted for the values the quantiles show to be hot.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrank.functions.joins import row_salt, salt_width, spread_width
from evidrank.functions.rows import as_col
from evidrank.sources.stages import cut, settle

MAX_BUCKETS = 10_000


def _array_sql(numbers: Iterable[float]) -> str:
    """One array literal as text: a single call into the JVM instead of one per number."""
    return "array(" + ", ".join(f"double('{x!r}')" for x in numbers) + ")"


@dataclass(frozen=True)
class Bounds:
    """Sorted bucket bounds and the values that fill at least a bucket on their own."""

    edges: tuple[float, ...]
    hot: tuple[float, ...]

    def bucket(self, value: Column) -> Column:
        """Number of edges below ``value``; two steps, so about 2*sqrt(k) comparisons instead of k."""
        if not self.edges:
            return F.lit(0)
        step = max(1, isqrt(len(self.edges)))
        groups = [self.edges[i : i + step] for i in range(0, len(self.edges), step)]
        tops = F.expr(_array_sql(g[-1] for g in groups))
        inner = F.expr(f"array({', '.join(_array_sql(g) for g in groups)})")
        whole = F.size(F.filter(tops, lambda e: e < value))
        rest = F.coalesce(F.size(F.filter(F.get(inner, whole), lambda e: e < value)), F.lit(0))
        rest = F.when(whole < len(groups), rest).otherwise(0)
        return F.least(whole * step + rest, F.lit(len(self.edges))).cast("int")

    def is_hot(self, value: Column) -> Column:
        return value.isin(*self.hot) if self.hot else F.lit(False)


def measure_bounds(df: DataFrame, values: Mapping[str, Column | str]) -> dict[str, Bounds]:
    """Quantile bounds for several value columns in one pass (a mergeable sketch; at most k numbers each return).

    Two marks per shuffle partition: a value that fills a whole partition's share meets two marks and counts as hot.
    """
    k = min(MAX_BUCKETS, max(64, 2 * spread_width(df)))
    probabilities = [i / k for i in range(1, k)]
    sketches = [
        F.percentile_approx(as_col(v).cast("double"), probabilities, max(10_000, 10 * k)).alias(name)
        for name, v in values.items()
    ]
    row = df.agg(*sketches).first()
    result = {}
    for name in values:
        marks = row[name] or []
        edges = sorted(set(marks))
        hot = sorted({a for a, b in zip(marks, marks[1:]) if a == b})
        result[name] = Bounds(tuple(edges), tuple(hot))
    return result


def value_table(df: DataFrame, value: str, bounds: Bounds | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct known value (and group): ``n_ties``, ``n_upto`` (rows with value <= this), ``n_total``."""
    by = list(by)
    bounds = bounds or measure_bounds(df, {"v": value})["v"]
    v = F.col(value)
    counts = (
        df.where(v.isNotNull() & ~F.isnan(v.cast("double")))  # NaN is no value
        .groupBy(*by, v.cast("double").alias(value))
        .agg(F.count(F.lit(1)).alias("n_ties"))
        .withColumn("_bucket", bounds.bucket(F.col(value)))
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("_running", F.sum("n_ties").over(inside))
    totals = counts.groupBy(*by, "_bucket").agg(F.sum("n_ties").alias("_rows"))
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = across.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(across).alias("n_total"),
    )
    if not by:
        offsets = F.broadcast(offsets)  # at most MAX_BUCKETS rows, whatever the input size
    return running.join(offsets, [*by, "_bucket"]).select(
        *by, value, "n_ties", (F.col("_offset") + F.col("_running")).alias("n_upto"), "n_total"
    )


def attach_table(df: DataFrame, table: DataFrame, value: str, bounds: Bounds, by: Sequence[str] = ()) -> DataFrame:
    """Left join a ``value_table`` back onto rows; hot values and NULLs are salted over all tasks."""
    by = list(by)
    width = salt_width(df)
    v = F.col(value).cast("double")
    scatter = v.isNull() | bounds.is_hot(v)
    rows = df.withColumn("_key", v).withColumn("_salt", F.when(scatter, row_salt(df, width)).otherwise(0))
    side = table.withColumnRenamed(value, "_key")
    if bounds.hot:
        copies = F.when(bounds.is_hot(F.col("_key")), F.sequence(F.lit(0), F.lit(width - 1)))
        side = side.withColumn("_salt", F.explode(F.coalesce(copies, F.array(F.lit(0)))))
    else:
        side = side.withColumn("_salt", F.lit(0))
    return rows.join(side, [*by, "_key", "_salt"], "left").drop("_key", "_salt")


def average_rank() -> Column:
    return F.col("n_upto") - (F.col("n_ties") - 1) / F.lit(2.0)


def with_percentile(df: DataFrame, columns: Mapping[str, str], over: str = "count") -> DataFrame:
    """Average-rank percentile of each value column, NULL where the value is NULL.

    ``columns`` maps output name to value column. ``over="count"`` divides by the number of known values,
    ``over="max"`` by the largest average rank (so the top value always gets 1). The rows are read once per column and
    once for the bounds, so an input behind a shuffle is settled first.
    """
    df = settle(df)
    bounds = measure_bounds(df, columns)
    for out, value in columns.items():
        table = value_table(df, value, bounds[out]).select(value, average_rank().alias("_avg"), "n_total")
        if over == "max":
            top = table.agg(F.max("_avg").alias("_top")).scalar()
            table = table.select(value, (F.col("_avg") / top).alias(out))
        else:
            table = table.select(value, (F.col("_avg") / F.col("n_total")).alias(out))
        df = attach_table(df, table, value, bounds[out])
    return df


def percent_rank_table(df: DataFrame, value: str, bounds: Bounds, out: str = "percentile_rank") -> DataFrame:
    """SQL ``PERCENT_RANK() OVER (ORDER BY value)`` per distinct value."""
    first = F.col("n_upto") - F.col("n_ties")
    ratio = F.when(F.col("n_total") > 1, first / (F.col("n_total") - 1)).otherwise(F.lit(0.0))
    return value_table(df, value, bounds).select(value, ratio.alias(out))


def with_percent_rank(df: DataFrame, value: str, out: str = "percentile_rank") -> DataFrame:
    """``PERCENT_RANK`` over the known values, NULL where the value is NULL."""
    df = settle(df)
    bounds = measure_bounds(df, {"v": value})["v"]
    return attach_table(df, percent_rank_table(df, value, bounds, out), value, bounds)


def quantiles(df: DataFrame, value: str, probabilities: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles (``PERCENTILE_CONT``) without holding a group in one task.

    Only the distinct values on both sides of each wanted position survive the filter inside the aggregate.
    """
    table = value_table(settle(df.select(*by, value)), value, by=by)
    start = F.col("n_upto") - F.col("n_ties")
    n = F.col("n_total")
    aggs = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (n - 1)
        for tag, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            aggs.append(F.max(F.when((start <= index) & (index < F.col("n_upto")), F.col(value))).alias(f"_{tag}_{name}"))
    aggs.append(F.max("n_total").alias("_n"))
    grouped = table.groupBy(*by).agg(*aggs)
    out = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return grouped.select(*by, *out)


def with_row_number(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """Global row number in a total order, exact for any sortable key (ties must be broken by ``order`` itself).

    Rows are range-partitioned and sorted once, and the sorted rows are written to the shared scratch folder together
    with their partition and in-partition index. Later reads see the written numbers, so nothing can shift.
    """
    sorted_rows = (
        settle(df)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mono"))
    )
    fixed = cut(sorted_rows).withColumn("_index", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        fixed.join(F.broadcast(offsets), "_part")  # one row per sort partition
        .withColumn(out, F.col("_offset") + F.col("_index") + 1)
        .drop("_part", "_mono", "_index", "_offset")
    )


def probe_positions(df: DataFrame, probes: DataFrame, value: str, tie: str, out: str = "position") -> DataFrame:
    """Where each probe stands among all rows by (value descending, tie ascending): ``probes`` plus ``out``, from 1.

    ``probes`` has distinct (value, tie) pairs; ``df`` is read three times and never sorted. The position of a probe is
    one more than the rows with a greater value, and the rows with its value and a smaller tie-breaker:

    * whole buckets above come from bucket totals; in the buckets that hold a probe, and only there, rows are counted
      per value;
    * a row that shares its value with probes counts towards the first of their tie-breakers that is greater, so a tie
      that holds a third of the table costs one count per probe and task. The join that brings it the tie-breakers is
      salted for such values.

    NULL and NaN values are no rows.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias(value), F.col(tie).alias("_row_tie"))
    bounds = measure_bounds(rows, {"v": value})["v"]
    bucketed = rows.withColumn("_bucket", bounds.bucket(F.col(value)))
    asked = probes.withColumn("_bucket", bounds.bucket(F.col(value).cast("double")))
    sizes = {r["_bucket"]: r["count"] for r in bucketed.groupBy("_bucket").count().collect()}  # at most MAX_BUCKETS rows
    used = sorted(r[0] for r in asked.select("_bucket").distinct().collect())  # as many
    beyond = dict(zip(sorted(sizes, reverse=True), accumulate((sizes[b] for b in sorted(sizes, reverse=True)), initial=0)))
    totals = df.sparkSession.createDataFrame([(b, beyond.get(b, 0)) for b in used], "_of int, _beyond bigint")
    counts = bucketed.where(F.col("_bucket").isin(used)).groupBy("_bucket", value).agg(F.count(F.lit(1)).alias("_ties"))
    inside = Window.partitionBy("_bucket").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_inside", F.coalesce(F.sum("_ties").over(inside), F.lit(0)))
    # By text: from an equality of the bucket columns the optimizer would infer a filter that has no input.
    same = F.col("_bucket").cast("string") == F.col("_of").cast("string")
    above = counts.join(F.broadcast(totals), same).select(value, (F.col("_beyond") + F.col("_inside")).alias("_above"))
    ties = asked.groupBy(F.col(value).cast("double").alias(value)).agg(F.sort_array(F.collect_set(tie)).alias("_asked"))
    met = attach_table(rows, ties, value, bounds).where(F.col("_asked").isNotNull())
    place = F.size(F.filter("_asked", lambda t: t <= F.col("_row_tie")))  # probes that do not stand below this row
    before = met.groupBy(F.col(value).alias("_value"), place.cast("int").alias("_place")).agg(F.count(F.lit(1)).alias("_n"))
    # The rows before probe number p (from 0) of its value are those of all places up to p.
    numbered = ties.select(F.col(value).alias("_value"), F.posexplode("_asked").alias("_place", "_tie"), F.lit(0).alias("_n"))
    upto = Window.partitionBy("_value").orderBy("_place").rangeBetween(Window.unboundedPreceding, 0)
    both = numbered.unionByName(before, allowMissingColumns=True).withColumn("_smaller", F.sum("_n").over(upto))
    latest = both.where(F.col("_tie").isNotNull()).select("_value", "_tie", "_smaller")
    key = F.col(value).cast("double")
    placed = probes.join(above.withColumnRenamed(value, "_value"), key == F.col("_value"), "left").drop("_value")
    placed = placed.join(latest, (key == F.col("_value")) & (F.col(tie) == F.col("_tie")), "left").drop("_value", "_tie")
    return placed.withColumn(out, F.coalesce("_above", F.lit(0)) + F.coalesce("_smaller", F.lit(0)) + 1).drop("_above", "_smaller")
