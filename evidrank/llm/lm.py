"""Stupid-backoff scores of every document by the n-gram counts of the whole corpus.

With c the corpus counts, N the words of the corpus and b the backoff factor, a word scores c(u v w) / c(u v) if the
trigram occurs ``least`` times or more, else b * c(v w) / c(v) if the bigram does, else b * b * c(w) / N; at the
beginning of a document the orders that do not exist yet are skipped without a factor. A document's score is the sum of
the logarithms.

Counting and scoring are one join of n-grams with counts, partitioned by the n-gram's hash. Documents are taken in
blocks of about ``block`` words. A block's distinct n-grams, exploded and counted once per block, go to the partition
of their hash as sorted runs of 56-bit hashes, delta-coded; there the runs of all blocks are merged into the count
table of that partition, and every run is answered with its totals. A block then meets its answers and sums them per
document. So an n-gram that every document holds costs one entry per block, however often it occurs, a partition's size
follows the number of partitions, which follows the size of the text, and what is shuffled grows with the corpus.

Two different n-grams share a 56-bit hash about once in 7e16 pairs. NULL texts are empty; a document without words has
score 0 and no mean. Repeated rows count and score as often as they occur. NULL ids are kept. Other columns are ignored;
an empty table has no rows. Both passes read ``docs``, which must be a table (or settled): a block that differs between
them is noticed and stops the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.llm.common import settled, whole_text

ORDER, HASH_BITS = 3, 56
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = [np.uint64(s) for s in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_HALF = np.uint64(31)


@dataclass(frozen=True)
class Backoff:
    factor: float = 0.4
    least: int = 2
    block: int = 1_000_000
    #: Characters of text per hash partition.
    partition_chars: int = 4_000_000


class _Words(dict):
    """Hash of a word; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


def _hashes(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """56-bit hashes of all unigrams, bigrams and trigrams within documents, in this order, and the ends of the latter
    two. Documents follow each other in ``words``."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    two, three = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
    with np.errstate(over="ignore"):
        def mixed(order: int, *parts: np.ndarray) -> np.ndarray:
            h = np.full(len(parts[0]), _SEEDS[order], np.uint64)
            for part in parts:
                h = (h ^ part) * _MIX
                h ^= h >> _HALF
            return (h * _MIX) >> np.uint64(64 - HASH_BITS)

        grams = [mixed(0, words), mixed(1, words[two - 1], words[two]), mixed(2, words[three - 2], words[three - 1], words[three])]
    return np.concatenate(grams), two, three


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers, the bytes of equal weight together, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").reshape(-1)


@dataclass
class _Block:
    ids: list
    sizes: list[int]
    words: list[np.ndarray]

    @property
    def all_words(self) -> np.ndarray:
        return np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, _Block]]:
    """(number, block) of a task's documents; numbers are unique over all tasks."""
    number, block, held = TaskContext.get().partitionId() << 32, _Block([], [], []), 0
    for rows in batches:
        for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            words = text.lower().split()  # of bytes: A-Z and ASCII white space only
            block.ids.append(doc_id)
            block.sizes.append(len(words))
            block.words.append(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)))
            held += len(words)
            if held >= size:
                yield number, block
                number, block, held = number + 1, _Block([], [], []), 0
    if block.ids:
        yield number, block


_RUN_SQL = "bucket int, block long, grams binary, counts binary"
_RUN = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
_PART_SQL = "block long, bucket int, doc_ids array<long>, sizes array<long>, words binary, data binary"
_PART = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
    + [("words", pa.binary()), ("data", pa.binary())]
)
_SCORE_SQL = "doc_id long, n_words long, n_trigram long, n_bigram long, n_unigram long, logs double"
_SCORE = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_trigram", pa.int64()), ("n_bigram", pa.int64())]
    + [("n_unigram", pa.int64()), ("logs", pa.float64())]
)


def _runs(docs: DataFrame, buckets: int, p: Backoff) -> DataFrame:
    """Per block and bucket the distinct n-grams with the times they occur in the block."""
    edges = np.array([(k << HASH_BITS) // buckets for k in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, p.block):
            grams, counts = np.unique(_hashes(block.all_words, np.array(block.sizes, np.int64))[0], return_counts=True)
            cuts = [0, *np.searchsorted(grams, edges).tolist(), len(grams)]
            rows = [
                (k, number, _pack(np.diff(grams[a:b], prepend=np.uint64(0))), _pack(counts[a:b]))
                for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
                if b > a
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUN)], schema=_RUN)

    return docs.mapInArrow(run, _RUN_SQL)


def _answers(runs: DataFrame) -> DataFrame:
    """Merge the runs of a bucket into its count table and give every run the totals of its n-grams."""

    def run(group: pa.Table) -> pa.Table:
        grams = [np.cumsum(_unpack(g)) for g in group.column("grams").to_pylist()]
        counts = np.concatenate([_unpack(c) for c in group.column("counts").to_pylist()])
        sizes = [len(g) for g in grams]
        _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(inverse, weights=counts).astype(np.uint64)[inverse]
        data = [_pack(part) for part in np.split(totals, np.cumsum(sizes)[:-1])]
        n = len(data)
        columns = [group.column("block"), group.column("bucket"), [None] * n, [None] * n, [None] * n, data]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, _PART)], schema=_PART)

    return runs.groupBy("bucket").applyInArrow(run, _PART_SQL)


def _word_rows(docs: DataFrame, p: Backoff) -> DataFrame:
    """Per block its documents as numbers of words of the block's own vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, p.block):
            vocabulary, times, words = _ranked(block.all_words)
            row = [[number], [-1], [block.ids], [block.sizes], [_pack(words)], [vocabulary.astype("<u8").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _PART)], schema=_PART)

    return docs.mapInArrow(run, _PART_SQL)


def _ranked(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary by falling frequency, its counts, and the words as ranks: frequent words get small numbers."""
    vocabulary, inverse, times = np.unique(words, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return vocabulary[order], times[order], rank[inverse]


def _score_block(sizes: np.ndarray, words: np.ndarray, totals: np.ndarray, p: Backoff) -> list[np.ndarray]:
    """n_trigram, n_bigram, n_unigram and the summed logarithms (without N) per document."""
    n = len(words)
    grams, two, three = _hashes(words, sizes)
    unique, inverse = np.unique(grams, return_inverse=True)
    if len(unique) != len(totals):
        raise RuntimeError("a block changed between the two passes over docs; settle docs before scoring it")
    counts = totals[inverse].astype(np.float64)
    one, pair, triple = counts[:n], np.zeros(n), np.zeros(n)
    pair[two], triple[three] = counts[n : n + len(two)], counts[n + len(two) :]
    has2, has3 = pair > 0, triple > 0
    use3 = has3 & (triple >= p.least)
    use2 = ~use3 & has2 & (pair >= p.least)
    with np.errstate(divide="ignore", invalid="ignore"):
        before1, before2 = np.log(np.concatenate([[1.0], one[:-1]])), np.log(np.concatenate([[1.0], pair[:-1]]))
        logs = np.where(use3, np.log(triple) - before2, np.where(use2, np.log(pair) - before1, np.log(one)))
    tried = np.where(use3, 0, np.where(use2, has3, has3.astype(int) + has2))
    logs = logs + tried * np.log(p.factor)
    ends = np.cumsum(sizes)
    add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)
    document = np.repeat(np.arange(len(sizes)), sizes)
    return [add(use3), add(use2), add(~use3 & ~use2), np.bincount(document, weights=logs, minlength=len(sizes))]


def score(docs: DataFrame, p: Backoff = Backoff()) -> DataFrame:
    """doc_id, n_words, the words scored at each order, log_score and its mean per word."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    chars = docs.agg(F.sum(F.octet_length(whole_text()))).first()[0] or 0
    buckets = 1 + chars // p.partition_chars

    def run(group: pa.Table) -> pa.Table:
        parts = sorted(group.select(["bucket", "data"]).to_pylist(), key=lambda r: r["bucket"])
        own = group.filter(pc.equal(group.column("bucket"), -1))
        if own.num_rows != 1:
            raise RuntimeError("a block changed between the two passes over docs; settle docs before scoring it")
        ids, sizes = own.column("doc_ids")[0].as_py(), np.array(own.column("sizes")[0].as_py(), np.int64)
        vocabulary = np.frombuffer(parts[0]["data"], "<u8")
        ranks = _unpack(own.column("words")[0].as_py()).astype(np.int64)
        words = vocabulary[ranks[: int(sizes.sum())]]
        totals = np.concatenate([np.zeros(0, np.uint64), *(_unpack(r["data"]) for r in parts[1:])])
        columns = [ids, sizes, *_score_block(sizes, words, totals, p)]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SCORE)], schema=_SCORE)

    answers = _answers(_runs(read, buckets, p))
    scored = settled(_word_rows(read, p).unionByName(answers).groupBy("block").applyInArrow(run, _SCORE_SQL))
    total = scored.agg(F.sum("n_words")).first()[0] or 1
    rows = scored.withColumn("log_score", F.col("logs") - F.col("n_unigram") * F.log(F.lit(float(total))))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return rows.select("doc_id", "n_words", "n_trigram", "n_bigram", "n_unigram", "log_score", mean.alias("mean_log_score"))
