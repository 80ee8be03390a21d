"""Substring dedup: words covered by a long passage that an earlier document holds too are removed, exactly.

A window is ``width`` consecutive words; it is removed where its words also start in a document with a smaller doc_id.
Windows are counted by super-k-mer partitioning:

1. The minimiser of a window is the least hash among its sequences of ``part`` words. Consecutive windows that share
   it are one super-k-mer. Copies of a text count once, through the document with the smallest id.
2. Equal windows have equal minimisers, so only those met in two documents matter. Their super-k-mers travel as one
   packed string each to the bucket of the minimiser.
3. There all windows are sorted (names of equal blocks, no hash decides) and each gets the smallest id that holds it.
   A crowded bucket is not gathered: its strings collapse first, map-side, and their windows are dealt out by a 128-bit
   digest of their own.
4. What each string learns goes back to the documents that hold it, as ranges of words.

A text is shuffled twice at most: where it shares a minimiser, to cut its strings, and to be rid of its ranges. No
group grows with the number of copies, and nothing is capped.

NULL texts have no words. A NULL doc_id is neither smaller nor larger than any: such rows stay whole and remove nothing.
Rows that repeat a doc_id do not remove each other's words. Texts shorter than a window stay whole. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrank.llm import blocks
from evidrank.llm.common import settled, whole_text

WIDTH, PART = 50, 20
#: Windows of one packed string, at most; longer super-k-mers travel as several.
_LONGEST = 512
#: A bucket of more super-k-mers than this is crowded.
CROWDED = 1_000
#: Windows that are sorted together.
_GATHER = 50_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _digest(text: Column) -> Column:
    """128 bits that stand for the text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def super_kmers(words: list[bytes], width: int = WIDTH, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of every super-k-mer of a list of words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = {w: xxhash.xxh64_intdigest(w) for w in dict.fromkeys(words)}
    hashes = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    size = len(words) - part + 1
    low = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(part):
            low = (low ^ (low >> np.uint64(29))) * _MIX + hashes[k : k + size]
        low = (low ^ (low >> np.uint64(32))) * _MIX
    span, reach = width - part + 1, 1  # minima over reach, doubled up to the span
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[:n], low[span - reach : span - reach + n]).view(np.int64)
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    long = np.diff(np.concatenate([first, [n]]))
    if long.max() > _LONGEST:
        first = np.concatenate([np.arange(a, a + k, _LONGEST) for a, k in zip(first.tolist(), long.tolist())])
        long = np.diff(np.concatenate([first, [n]]))
    return first, long, low[first]


def _texts(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(text).alias("digest"), text.cast("binary").alias("text"))


def _representatives(docs: DataFrame, width: int, part: int) -> DataFrame:
    """doc_id (smallest of the equal texts), digest, copies (rows with that text), and the super-k-mers, per text."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("at", longs), ("n", longs), ("mini", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [super_kmers(t.split(), width, part) for t in rows.column(2).to_pylist()]
            lists = [pa.array([f[k] for f in found], longs) for k in range(3)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists], schema=schema)

    read = _texts(docs).where("doc_id is not null")
    rows = read.mapInArrow(run, "doc_id long, digest binary, at array<long>, n array<long>, mini array<long>")
    least = F.min_by(F.struct("at", "n", "mini"), "doc_id").alias("s")
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), least).select("doc_id", "digest", "copies", "s.*")


def _strings(docs: DataFrame, texts: DataFrame, width: int, crowd: int) -> DataFrame:
    """doc_id, digest, at, key, mini, crowded and the packed words of every super-k-mer whose minimiser two texts share.

    ``texts`` are the representatives; the string holds ``width`` - 1 words more than it has windows.
    """
    pieces = texts.select("doc_id", "digest", F.inline(F.arrays_zip("at", "n", "mini")))
    shared = pieces.groupBy("mini").agg(F.count(F.lit(1)).alias("crowd"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    shared = shared.where("a < b").select("mini", (F.col("crowd") > crowd).alias("crowded"))
    asked = pieces.join(shared, "mini").groupBy("doc_id", "digest").agg(F.collect_list(F.struct("at", "n", "mini", "crowded")).alias("asked"))
    met = _texts(docs).join(asked.withColumnRenamed("digest", "wanted"), "doc_id").where("digest = wanted").select("doc_id", "digest", "asked", "text")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("digest", pa.binary()), ("at", pa.int64()), ("key", pa.binary()), ("mini", pa.int64()),
        ("crowded", pa.bool_()), ("packed", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = []
            for doc_id, digest, asked, text in zip(*(c.to_pylist() for c in rows.columns)):
                words = text.split()
                for one in asked:
                    at = one["at"]
                    packed = b" ".join(words[at : at + one["n"] + width - 1])
                    made.append((doc_id, digest, at, blake2b(packed, digest_size=16).digest(), one["mini"], one["crowded"], packed))
                if len(made) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)
                    made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    return met.mapInArrow(run, "doc_id long, digest binary, at long, key binary, mini long, crowded boolean, packed binary")


_SPANS = pa.list_(pa.struct([("since", pa.int64()), ("until", pa.int64()), ("first", pa.int64())]))
_LEARNT = pa.schema([("key", pa.binary()), ("spans", _SPANS)])
_LEARNT_SQL = "key binary, spans array<struct<since: long, until: long, first: long>>"


def first_holders(strings: list[bytes], lows: list[int], width: int) -> list[np.ndarray]:
    """For each packed string, the smallest id that holds each of its windows; ``lows`` has the smallest of each string."""
    number: dict[bytes, int] = {}
    symbols, offsets = [], []
    for packed in strings:
        words = packed.split(b" ")
        offsets.append(len(symbols))
        symbols.extend([number.setdefault(w, len(number)) for w in words])
    offsets.append(len(symbols))
    names = blocks.windows(np.array(symbols, np.int64), width)
    own = [names[a : b - width + 1] for a, b in zip(offsets, offsets[1:])]
    all_names = np.concatenate(own)
    ids = np.repeat(np.array(lows, np.int64), [len(o) for o in own])
    least = np.full(int(all_names.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, all_names, ids)
    return [least[o] for o in own]


def _in_buckets(strings: DataFrame, width: int) -> DataFrame:
    """key and spans (since, until, first): windows of a string that a document before some holder of the string holds."""

    def learnt(bucket: dict[bytes, list]) -> pa.RecordBatch:
        packed = list(bucket)
        keys, spans = [], []
        for (low, high, key), first in zip(bucket.values(), first_holders(packed, [v[0] for v in bucket.values()], width)):
            edges = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]])
            own = [{"since": a, "until": b, "first": int(first[a])} for a, b in zip(edges.tolist(), edges[1:].tolist()) if first[a] < high]
            if own:
                keys.append(key)
                spans.append(own)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(spans, _SPANS)], schema=_LEARNT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: dict[bytes, list] = {}
        last, filled = None, 0
        for rows in batches:
            for mini, packed, key, doc_id in zip(*(c.to_pylist() for c in rows.columns)):
                if mini != last and filled >= _GATHER:
                    yield learnt(bucket)
                    bucket, filled = {}, 0
                last = mini
                if packed not in bucket:
                    bucket[packed] = [doc_id, doc_id, key]
                    filled += packed.count(b" ") + 2 - width
                else:
                    seen = bucket[packed]
                    seen[0], seen[1] = min(seen[0], doc_id), max(seen[1], doc_id)
        if bucket:
            yield learnt(bucket)

    rows = strings.select("mini", "packed", "key", "doc_id").repartition("mini").sortWithinPartitions("mini")
    return rows.mapInArrow(run, _LEARNT_SQL)


def _one_by_one(strings: DataFrame, width: int) -> DataFrame:
    """The same for crowded buckets: strings collapse, then every window meets its like by a digest of its words."""
    schema = pa.schema([("window", pa.binary()), ("key", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("since", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for key, packed, low, high in zip(*(c.to_pylist() for c in rows.columns)):
                words = packed.split(b" ")
                n = len(words) - width + 1
                made = [blake2b(b" ".join(words[i : i + width]), digest_size=16).digest() for i in range(n)]
                columns = [pa.array(made, pa.binary()), pa.array([key] * n, pa.binary()), pa.array([low] * n, pa.int64()), pa.array([high] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(n), pa.int64())], schema=schema)

    once = strings.groupBy("key", "packed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    held = settled(once.mapInArrow(run, "window binary, key binary, low long, high long, since long"))
    # A table of its own: the join then meets plain shuffles, and a window that very many strings hold can be split.
    first = held.groupBy("window").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last")
    met = held.join(settled(first.select("window", "first")), "window").where("first < high")
    span = F.struct("since", (F.col("since") + 1).alias("until"), "first")
    return settled(met.groupBy("key").agg(F.collect_list(span).alias("spans")))


def repeated(docs: DataFrame, width: int = WIDTH, part: int = PART, crowd: int = CROWDED) -> DataFrame:
    """digest, first (smallest doc_id with that text), and ranges of words to be removed from that document.

    Only texts of which there are several rows or some range. Ranges may overlap.
    """
    texts = settled(_representatives(docs, width, part))
    strings = settled(_strings(docs, texts, width, crowd))
    learnt = _in_buckets(strings.where("not crowded"), width).unionByName(_one_by_one(strings.where("crowded"), width))
    holders = strings.select("doc_id", "digest", "at", "key").join(learnt, "key")
    earlier = F.filter("spans", lambda s: s.first < F.col("doc_id"))
    spans = F.transform(earlier, lambda s: F.struct((F.col("at") + s.since).alias("a"), (F.col("at") + s.until + (width - 1)).alias("b")))
    found = holders.select("digest", spans.alias("spans")).where(F.size("spans") > 0)
    ranges = found.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("ranges"))
    known = texts.select("digest", F.col("doc_id").alias("first"), "copies").join(ranges, "digest", "left")
    return settled(known.where("copies > 1 or ranges is not null").select("digest", "first", "ranges"))


def _without(words: list[bytes], ranges: list[dict]) -> list[bytes]:
    change = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        change[r["a"]] += 1
        change[r["b"]] -= 1
    return [w for w, c in zip(words, change.cumsum().tolist()) if not c]


def dedup(docs: DataFrame, width: int = WIDTH, part: int = PART, crowd: int = CROWDED) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one space, of every row."""
    if not 0 < part <= width:
        raise ValueError("a minimiser is a part of a window")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes, removed, texts = [], [], []
            for doc_id, text, first, ranges in zip(*(c.to_pylist() for c in rows.columns)):
                words = text.split()
                kept = words
                if first is not None and doc_id is not None:
                    if doc_id > first:
                        kept = words if len(words) < width else []
                    elif ranges:
                        kept = _without(words, ranges)
                sizes.append(len(words))
                removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept).decode("utf-8", "replace"))
            made = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([rows.column(0), *made], schema=schema)

    met = _texts(docs).join(repeated(docs, width, part, crowd), "digest", "left").select("doc_id", "text", "first", "ranges")
    return met.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
