"""Delimited text sources: null tokens, comment lines, two-line preambles, compressed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrank.sources.lines import RANGE_BYTES, files_of, read_heads, read_lines

COMPRESSED = (".gz", ".bgz")
DEFAULT_NULLS = ("NA", "", ".")


def nullify(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Turn any of several null tokens into NULL in every column."""
    return df.select(
        *[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) for c in df.columns]
    )


def _spread(df: DataFrame, partitions: int | None) -> DataFrame:
    return df.repartition(partitions) if partitions else df


def _below_heads(spark: SparkSession, heads: dict[str, list[tuple[int, str]]], separator: str, range_bytes: int) -> DataFrame:
    """Every line below its file's head lines, split into the columns that the last head line names.

    The heads are told by their places in the file, so a row that repeats one is a row. Files with other columns, or in
    another order, are united by name.
    """
    by_header: dict[str, list[tuple[str, int]]] = {}
    for path, head in heads.items():
        by_header.setdefault(head[-1][1], []).append((path, head[-1][0]))
    parts = []
    for header, files in sorted(by_header.items()):
        names = [n.strip('"') for n in header.split(separator)]
        ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        below = read_lines(spark, files, range_bytes).where(F.col("line") != "")
        parsed = F.from_csv(F.col("line"), ddl, {"sep": separator, "mode": "PERMISSIVE"})
        parts.append(below.select(parsed.alias("row")).select("row.*"))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    separator: str = "\t",
    null_tokens: Sequence[str] = DEFAULT_NULLS,
    comment: str | None = None,
    partitions: int | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """All-string scan of delimited files with a header line.

    Compressed files are told by ``.gz`` or ``.bgz``. Block gzip under either name is read by several tasks, ``range_bytes``
    each; one ordinary gzip file is one task: give ``partitions`` to spread its rows before heavy work. With ``comment``
    the first line of a file is left out if it starts so, and no other: names may begin with that character too, and a
    row may repeat the comment or the header. A quoted field cannot hold a line break. Empty files have no rows.
    """
    files = files_of(spark, path)
    if not comment and not any(f.endswith(COMPRESSED) for f in files):
        reader = spark.read.option("header", True).option("sep", separator).option("enforceSchema", False)
        return _spread(nullify(reader.csv(path), null_tokens), partitions)
    heads = {}
    for file, head in read_heads(spark, files, 2).items():
        commented = bool(comment) and head[0][1].startswith(comment)
        if len(head) > commented:
            heads[file] = head[: 1 + commented]
    return _spread(nullify(_below_heads(spark, heads, separator, range_bytes), null_tokens), partitions)


def read_preamble(
    spark: SparkSession,
    path: str | list[str],
    separator: str = "\t",
    null_tokens: Sequence[str] = DEFAULT_NULLS,
    partitions: int | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Scan of files, compressed or not, that start with a version line, a dimension line and then the header.

    One job reads the three head lines of all files; only they are left out, by their places, whatever rows hold.
    """
    heads = {f: head for f, head in read_heads(spark, files_of(spark, path), 3).items() if len(head) == 3}
    return _spread(nullify(_below_heads(spark, heads, separator, range_bytes), null_tokens), partitions)
