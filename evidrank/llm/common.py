"""What several operators of this subpackage share: column access, settled tables and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrank.sources.stages import cut

BatchMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: A-Z to a-z and nothing else; Spark's lower() would also fold other alphabets.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch that a task turns into Python objects at a time.
_SLICE = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def settled(df: DataFrame) -> DataFrame:
    """Write rows that several steps read to the folder in spark.checkpoint.dir, and read them back."""
    return cut(df)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, few at a time: what is made of a slice is gone before the next one."""
    for rows in batches:
        for at in range(0, rows.num_rows, _SLICE):
            yield rows.slice(at, _SLICE)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def append(
    docs: DataFrame, work: Callable[[list], list[pa.Array]], added: dict[str, str], binary: bool = False, kept: list[str] | None = None
) -> DataFrame:
    """The columns of ``docs``, whatever their names, or ``kept``, then those that ``work`` makes of the list of whole texts.

    ``added`` maps names to "long", "int", "double", "string" or "binary". Rows keep their order and number.
    """
    names = docs.columns if kept is None else kept
    text = whole_text().cast("binary") if binary else whole_text()
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], text.alias("_text"))
    labels = [*(f"c{i}" for i in range(len(names))), *(f"n{i}" for i in range(len(added)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            made = work(rows.column(rows.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *made], names=labels)

    kinds = [*(f.dataType.simpleString() for f in plain.schema.fields[:-1]), *added.values()]
    made = plain.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(labels, kinds)))
    return made.select(*[F.col(n).alias(c) for n, c in zip(labels, [*names, *added])])
