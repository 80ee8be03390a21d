"""Row-level column expressions in which missing stays NULL and never turns into zero.

Everything here returns a ``Column`` built from JVM-side functions, so it stays inside whole-stage codegen. Only
``membership_sketch`` reads a table, to make its column.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REGEX_SPECIAL = set("\\^$.|?*+()[]{}")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ladder(cases: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """CASE ladder: the value of the first condition that holds, else ``default``."""
    expr = F
    for condition, value in cases:
        expr = expr.when(condition, value if isinstance(value, Column) else F.lit(value))
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def lookup(c: Column | str, mapping: Mapping[str, float], default: object = None) -> Column:
    """Category to number; categories outside the mapping (and NULL) give ``default``."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), as_col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def all_known(cols: Sequence[Column | str]) -> Column:
    return reduce(and_, [as_col(c).isNotNull() for c in cols])


def any_known(cols: Sequence[Column | str]) -> Column:
    return reduce(or_, [as_col(c).isNotNull() for c in cols])


def known_count(cols: Sequence[Column | str]) -> Column:
    return reduce(add, [as_col(c).isNotNull().cast("long") for c in cols])


def filled_sum(cols: Sequence[Column | str]) -> Column:
    """Sum in which a missing part adds nothing."""
    return reduce(add, [F.coalesce(as_col(c), F.lit(0)) for c in cols])


def known_sum(cols: Sequence[Column | str]) -> Column:
    """Sum over the known parts; NULL only when every part is missing."""
    return F.when(any_known(cols), filled_sum(cols))


def known_mean(cols: Sequence[Column | str]) -> Column:
    """Mean over the known parts; NULL when every part is missing."""
    parts = [as_col(c).cast("double") for c in cols]
    return F.try_divide(filled_sum(parts), known_count(parts).cast("double"))


def known_max(cols: Sequence[Column | str]) -> Column:
    """Largest known part (``greatest`` skips NULLs)."""
    parts = [as_col(c) for c in cols]
    return parts[0] if len(parts) == 1 else F.greatest(*parts)


def clip(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Clamp a known value into [low, high]; NULL stays NULL."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def log2_plus_one(c: Column | str) -> Column:
    return F.log2(as_col(c).cast("double") + F.lit(1.0))


def quote_regex(word: str) -> str:
    """Escape regex metacharacters the way both Java and RE2 read them."""
    return "".join("\\" + ch if ch in _REGEX_SPECIAL else ch for ch in word)


def contains_any(c: Column | str, words: Iterable[str]) -> Column:
    """Case-insensitive substring test for any word; NULL text gives NULL. Plain byte search, no regex."""
    text = F.lower(as_col(c))
    return reduce(or_, [text.contains(w.lower()) for w in words])


def mentions_any(c: Column | str, terms: Iterable[str]) -> Column:
    """Case-insensitive whole-word test for any term; NULL text gives NULL.

    A word ends where no ASCII letter, digit or underscore follows; boundaries are spelled out because engines disagree
    about ``\\b`` next to accents. Each term is first looked up as a plain substring. Only texts that hold it meet the
    regex, which starts with the literal, so the matcher can skip ahead instead of trying every position.
    """
    text = F.lower(as_col(c))

    def found(term: str) -> Column:
        word = quote_regex(term.lower())
        return text.contains(term.lower()) & text.rlike(f"{word}(?![a-z0-9_])(?<![a-z0-9_]{word})")

    return reduce(or_, [found(t) for t in terms])


def any_element_contains(arr: Column | str, words: Iterable[str]) -> Column:
    """True if an array element contains any word; NULL for a NULL or empty array."""
    arr = as_col(arr)
    hit = F.exists(arr, lambda x: F.coalesce(contains_any(x, words), F.lit(False)))
    return F.when(F.size(arr) > 0, hit)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(as_col(c)), F.lit(""))


def join_known(cols: Sequence[Column | str], separator: str) -> Column:
    """Join the non-blank parts; NULL when nothing is left."""
    return F.nullif(F.concat_ws(separator, *[blank_to_null(c) for c in cols]), F.lit(""))


def list_length(c: Column | str, separator: str = ",") -> Column:
    """Number of entries in a delimited string; NULL for NULL."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.size(F.split(c, quote_regex(separator))).cast("long"))


def strip_version(c: Column | str) -> Column:
    """Remove a trailing ``.<digits>`` version from an identifier."""
    return F.regexp_replace(as_col(c), r"\.\d+$", "")


def union_distinct(a: Column | str, b: Column | str) -> Column:
    """Distinct elements of two arrays; a missing or empty second array leaves the first untouched."""
    a, b = as_col(a), as_col(b)
    return F.when(F.size(b) > 0, F.array_distinct(F.concat(a, b))).otherwise(a)


def present_names(names: Mapping[str, Column | str]) -> Column:
    """Comma-joined names whose column is known; empty string when none is."""
    return F.concat_ws(",", *[F.when(as_col(c).isNotNull(), F.lit(n)) for n, c in names.items()])


def absent_names(names: Mapping[str, Column | str]) -> Column:
    """Comma-joined names whose column is missing; empty string when none is."""
    return F.concat_ws(",", *[F.when(as_col(c).isNull(), F.lit(n)) for n, c in names.items()])


#: Bits of a membership sketch: 4,096 longs, whatever the number of its words.
SKETCH_BITS = 1 << 18


def membership_sketch(words: DataFrame, column: str, bits: int = SKETCH_BITS) -> Column:
    """A filter for the words of a column, as one literal: an array of longs in which each word sets one bit.

    Words are set in the tasks and merged by OR; at most ``bits`` / 64 numbers reach the driver, however many words
    there are. More words only let more others pass.
    """
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    cells = words.where(F.col(column).isNotNull()).select(F.shiftright(place, 6).alias("cell"), (place % 64).cast("int").alias("bit"))
    merged = cells.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    filled = {r["cell"]: r["bits"] for r in merged.collect()}
    # As text, since one parse is far cheaper than thousands of calls into the JVM; the least long has no literal.
    cell = lambda n: f"{n}L" if n != -(1 << 63) else f"({n + 1}L - 1L)"
    return F.expr(f"array({', '.join(cell(filled.get(i, 0)) for i in range(bits // 64))})")


def may_hold(sketch: Column, word: Column, bits: int = SKETCH_BITS) -> Column:
    """False only where the word is none of the sketch's words."""
    place = F.pmod(F.xxhash64(word), F.lit(bits))
    return F.getbit(F.get(sketch, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1
