"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs with one word between them, of the whole text,
lower-cased. Each feature counts once per text, so a long text does not dilute a short insult.

Training takes a bounded sample of the labelled rows: of each class the ``max_rows`` / 2 rows with the smallest hash of
their id; the intercept is shifted by what that changes in the odds of the classes. Features are computed where the texts are; only coordinates of the sample go to the one task that runs
FTRL-proximal (per-coordinate rates, L1) over a few epochs. L1 leaves few of the 2**``bits`` coordinates non-zero, so
the weights fit a broadcast whatever the corpus; scoring reads all rows.

Only rows with crc32(doc_id as text) mod 5 <> 0 train; the others are held out. Rows whose label or id is NULL do not
train; a document labelled several times counts as toxic if one label says so. NULL texts score as empty ones: by the
intercept alone. A NULL doc_id is not held out. Without labelled rows every score is 0. Repeated rows score alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrank.llm.common import append, batch, settled, whole_text

FOLDS = 5


@dataclass(frozen=True)
class Ftrl:
    bits: int = 22
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.01
    epochs: int = 6
    max_rows: int = 16_000


_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)
_MARKS = "\"'()[]{}<>.,;:!?*_-|/\\#%&+=~`“”„«»…¡¿"


class _Words(dict):
    """Hash of a word without the marks around it; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.strip(_MARKS).encode())
        return value


_WORDS = _Words()


def features(text: str, bits: int) -> np.ndarray:
    """Coordinates of a text's words, pairs and skip pairs, repeats included."""
    words = text.lower().split()
    one = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        two = (one[:-1] * _PAIR) ^ (one[1:] >> _SHIFT) ^ one[1:]
        skip = (one[:-2] * _SKIP) ^ (one[2:] >> _SHIFT) ^ one[2:]
        mixed = np.concatenate([one, two, skip]) * _PAIR
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def is_held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def known_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the labelled rows that may train and are among ``docs``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return settled(known.join(here, "doc_id", "left_semi"))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, toxic and text of the sample. Only its ids and labels are broadcast, at most ``max_rows`` rows."""
    return _sample(docs, known_rows(docs, labels), max_rows)


def _sample(docs: DataFrame, known: DataFrame, max_rows: int) -> DataFrame:
    half = [known.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for c in ("toxic = 1", "toxic <> 1")]
    chosen = settled(half[0].unionByName(half[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), whole_text().alias("text"))
    return texts.join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).select("doc_id", "toxic", "text")


def log_odds_shift(known: DataFrame, max_rows: int) -> float:
    """What the intercept lacks because the classes are cut to the same number: log known over sampled toxic rows, less
    the same of the clean ones."""
    toxic = F.col("toxic") == 1
    n = known.agg(F.count_if(toxic).alias("toxic"), F.count_if(~toxic).alias("clean")).first()
    lost = lambda rows: math.log(max(1.0, rows / max(1, max_rows // 2)))
    return lost(n["toxic"]) - lost(n["clean"])


def _fit(rows: list[tuple[np.ndarray, int]], p: Ftrl) -> np.ndarray:
    """Weights after the epochs; the last coordinate is the intercept, which L1 and L2 leave alone."""
    size = 1 << p.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - np.where(at == size, 0.0, p.l1), 0.0)
        return -shrunk / ((p.beta + np.sqrt(n[at])) / p.alpha + np.where(at == size, 0.0, p.l2))

    for _ in range(p.epochs):
        for at, toxic in rows:
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - toxic
            step = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / p.alpha
            z[at] += gradient - step * w
            n[at] += gradient * gradient
    out = np.zeros(size + 1)
    met = np.flatnonzero(n)
    out[met] = weights(met)
    return out


def fit(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl()) -> DataFrame:
    """coordinate and weight, the non-zero ones; the intercept has coordinate -1."""
    size = 1 << params.bits
    rows_of = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("at", pa.list_(pa.int32()))])
    schema = pa.schema([("coordinate", pa.int64()), ("weight", pa.float64())])

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = [np.unique(features(t, params.bits)).astype(np.int32) for t in rows.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(at, rows_of.field(2).type)], schema=rows_of)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part in batches:
            ids, toxic, at = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)
            rows += [(xxhash.xxh64_intdigest(str(i)), np.append(at[k].values.to_numpy(), np.int32(size)), y) for k, (i, y) in enumerate(zip(ids, toxic))]
        if rows:
            rows.sort(key=lambda r: (r[0], len(r[1])))  # the order of arrival may differ when a task is retried
            w = _fit([r[1:] for r in rows], params)
            w[size] += shift
            at = np.flatnonzero(w)
            yield batch(schema, np.where(at == size, -1, at), w[at])

    known = known_rows(docs, labels)
    shift = log_odds_shift(known, params.max_rows)
    sample = _sample(docs, known, params.max_rows).mapInArrow(coordinates, "doc_id long, toxic int, at array<int>")
    return settled(sample.repartition(1).mapInArrow(train, "coordinate long, weight double"))


def _text_score(text: str, w: np.ndarray, params: Ftrl) -> float:
    at = features(text, params.bits)
    return w[np.unique(at[w[at] != 0])].sum(dtype=np.float64) + w[-1]


def score(docs: DataFrame, weights: DataFrame, params: Ftrl = Ftrl(), out: str = "score") -> DataFrame:
    """The columns of ``docs``, then the score. The weights (at most 2**bits + 1 numbers) travel with the tasks."""
    size = 1 << params.bits
    dense = np.zeros(size + 1, np.float32)
    table = weights.select("coordinate", "weight").toArrow()
    known = table.num_rows > 0
    if known:
        at = table.column(0).to_numpy()
        dense[np.where(at < 0, size, at)] = table.column(1).to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(dense)

    def work(texts: list[str]) -> list[pa.Array]:
        if not known:
            return [pa.array(np.zeros(len(texts)))]
        w = held.value
        sums = [_text_score(t, w, params) for t in texts]
        return [pa.array(1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -700, 700))))]

    return append(docs, work, {out: "double"})
