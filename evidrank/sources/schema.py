"""Declared schemas: lenient casts and back-filled columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lenient(c: Column | str, data_type: str | T.DataType) -> Column:
    """Cast that turns an unreadable value, NaN among them, into NULL (a plain cast raises under ANSI mode)."""
    c = F.col(c) if isinstance(c, str) else c
    value = c.try_cast(data_type)
    name = data_type if isinstance(data_type, str) else data_type.simpleString()
    return F.when(~F.isnan(value), value) if name.lower() in ("double", "float") else value


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns, in order and type; columns the input lacks come back as typed NULLs."""
    have = set(df.columns)
    return df.select(
        *[
            (lenient(F.col(f"`{f.name}`"), f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def backfill(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the columns the input lacks as typed NULLs; leave the rest alone."""
    missing = {n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def empty_like(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def resolve_aliases(
    df: DataFrame, variants: Mapping[str, Sequence[str]], twins: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Rename source columns to target names.

    Each target takes its first listed variant that the source has and no earlier target took. ``twins`` name targets
    that stand in for one another when only one of the two was found. With no match at all the input is unchanged.
    """
    taken: dict[str, str] = {}
    for target, names in variants.items():
        found = next((n for n in names if n in df.columns and n not in taken.values()), None)
        if found is not None:
            taken[target] = found
    if not taken:
        return df
    for a, b in twins:
        if (a in taken) != (b in taken):
            taken[b if a in taken else a] = taken.get(a) or taken[b]
    return df.select(*[F.col(f"`{source}`").alias(target) for target, source in taken.items()])


def find_column(columns: Iterable[str], all_of: Sequence[str] = (), any_of: Sequence[str] = (), pick: str = "first"):
    """Name of a column whose lower-cased name has every ``all_of`` word and at least one ``any_of`` word, or None."""
    hits = [
        c
        for c in columns
        if all(w in c.lower() for w in all_of) and (not any_of or any(w in c.lower() for w in any_of))
    ]
    if not hits:
        return None
    return hits[0] if pick == "first" else hits[-1]
