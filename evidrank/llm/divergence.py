"""Source divergence audit: how much the word use of every two sources of a language differs, and through which terms.

A language keeps the terms that at least ``least`` of its documents hold. A group (lang, source) gives a kept term with
``count`` occurrences the smoothed share p = 1 + floor(SCALE * (count + 5) / (N + 5 V)), N being the group's
occurrences of kept terms and V the number of kept terms; the language as a whole has shares by the same rule. The
divergence of two sources is the sum of |p - q| over all kept terms, in whole numbers.

Sources and terms form a cube: sources of a language are dealt into blocks, its terms as well, and a task owns one cell
(source block, source block, term block). Each slice of shares is replicated to the cells of its block; a cell fills two
small dense matrices, sums the absolute differences of its pairs of sources, and the partial sums are added along the
term axis. A cell's size is fixed by the block sizes, however many documents, terms or sources there are.

NULL lang, source and text count as ''. Groups without terms and languages without kept terms take part (value 0). Repeated rows
count as often as they stand there. doc_id and other columns are not read. Ties go by item, in the order of UTF-8. An
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrank.llm.common import settled

LEAST, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Sources and terms of a block, on average.
SOURCES, TERMS = 32, 4096
#: Entries a task counts before it passes them on.
_FULL = 400_000
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and held (documents): partial counts, several rows for one term."""
    schema = pa.schema([(c, pa.string()) for c in ("lang", "source", "term")] + [("n", pa.int64()), ("held", pa.int64())])

    def passed(counts: dict, held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in counts.items():
            size = len(terms)
            names = pa.array([t.decode("utf-8", "replace") for t in terms], pa.string())
            numbers = [pa.array(c.values(), pa.int64()) for c in (terms, held[lang, source])]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), names, *numbers], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = {}, {}, 0
        for rows in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in rows.columns)):
                own = Counter(_TERM.findall(text.lower()))
                into, docs_of = counts.setdefault((lang, source), {}), held.setdefault((lang, source), {})
                size -= len(into)
                for term, n in own.items():
                    into[term] = into.get(term, 0) + n
                    docs_of[term] = docs_of.get(term, 0) + 1
                size += len(into)
                if size >= _FULL:
                    yield from passed(counts, held)
                    counts, held, size = {}, {}, 0
        yield from passed(counts, held)

    read = _named(docs).select("lang", "source", F.col("text").cast("binary"))
    return read.mapInArrow(run, "lang string, source string, term string, n long, held long")


def kept_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n (of the source), lang_n (of the language) of kept terms; leads marks one row per term."""
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    of_term = Window.partitionBy("lang", "term")
    rows = counts.select(
        "lang", "source", "term", "n", F.sum("held").over(of_term).alias("held"), F.sum("n").over(of_term).alias("lang_n"),
        (F.min("source").over(of_term) == F.col("source")).alias("leads"),
    )
    return rows.where(F.col("held") >= least).drop("held")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), by whole decimals; NULL without kept terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    below = (total + PRIOR * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", above, below).cast("long"))


def group_shares(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, total, kept, lang_total, sources, none: the share of a term that is absent), and shares
    (lang, source, term, p, q: the language's share, and the group's none, kept and sources) of the terms each holds."""
    rows = settled(kept_counts(docs, least))
    langs = rows.groupBy("lang").agg(F.sum(F.when(F.col("leads"), 1).otherwise(0)).alias("kept"), F.sum("n").alias("lang_total"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _named(docs).select("lang", "source").distinct()
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang").fillna(0, ["total", "kept", "lang_total"])
    groups = settled(groups.withColumn("none", F.coalesce(share(F.lit(0), F.col("total"), F.col("kept")), F.lit(0))))
    met = rows.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    return groups, met.select("lang", "source", "term", p.alias("p"), q.alias("q"), "none", "kept", "sources")


_CELL = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("part", pa.int64())])


def cell_sums(cell: pa.Table) -> pa.Table:
    """Sums of |p - q| over one cell's terms, for each pair of its two blocks of sources.

    Rows without a term introduce a source, with its share of absent terms and the number of kept terms. Terms that no
    source of the cell holds differ by the same amount for each of them; the first term block adds that for all terms,
    and every cell corrects it for the terms that it sees.
    """
    lang, low, high, block = (cell.column(c)[0].as_py() for c in ("lang", "lo", "hi", "terms"))
    term = cell.column("term").combine_chunks()
    heads = cell.filter(term.is_null())
    names, none = heads.column("source").to_pylist(), heads.column("p").to_numpy()
    side, kept = heads.column("own").to_numpy(), heads.column("kept")[0].as_py()
    seen = cell.filter(term.is_valid())
    index = {name: i for i, name in enumerate(names)}
    of = np.fromiter(map(index.__getitem__, seen.column("source").to_pylist()), np.int64, len(seen))
    coded = seen.column("term").combine_chunks().dictionary_encode()
    shares = np.repeat(none[:, None], len(coded.dictionary), axis=1)
    shares[of, coded.indices.to_numpy()] = seen.column("p").to_numpy()
    left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
    made: list[tuple] = []
    for k, i in enumerate(left.tolist()):
        others = left[k + 1 :] if low == high else right
        base = np.abs(none[others] - none[i])
        sums = np.abs(shares[others] - shares[i]).sum(axis=1) - base * shares.shape[1] + (base * kept if block == 0 else 0)
        made.extend((lang, names[i], names[j], int(s)) for j, s in zip(others.tolist(), sums))
    columns = zip(*made) if made else [()] * 4
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _CELL)], schema=_CELL)


def pair_sums(groups: DataFrame, shares: DataFrame, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """lang, a, b, value of every two sources of a language, each pair once."""
    across, along = F.ceil(F.col("sources") / sources).cast("int"), F.greatest(F.ceil(F.col("kept") / terms), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("source"), across).cast("int")
    heads = groups.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.col("none").alias("p"), "kept", own.alias("own"), across.alias("across"),
        F.explode(F.sequence(F.lit(0), along - 1)).alias("terms"),
    )
    slices = shares.select(
        "lang", "source", "term", "p", "kept", own.alias("own"), across.alias("across"), F.pmod(F.xxhash64("term"), along).cast("int").alias("terms")
    )
    rows = heads.unionByName(slices).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("across") - 1))).drop("across")
    cells = rows.select("lang", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "terms", "own", "source", "term", "p", "kept")
    parts = cells.groupBy("lang", "lo", "hi", "terms").applyInArrow(cell_sums, "lang string, a string, b string, part long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair`` ranks the other sources of the language by divergence, all of them; part ``term`` ranks the terms
    that the source uses more than its language by the difference of shares, the first ``top``.
    """
    groups, shares = group_shares(docs, least)
    shares = settled(shares)
    pairs = pair_sums(groups, shares, sources, terms)
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = pairs.select("lang", F.inline(both), "value")
    over = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(over, "term").where(F.col("rank") <= top))
