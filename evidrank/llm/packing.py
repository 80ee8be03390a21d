"""Packing token streams into training sequences by order-preserving dynamic programming.

Documents keep the order of the input's partitions; each ends with one separator id. A task sees its documents as one
stream of ids and chooses where to cut it: after a document (free), after a sentence (``sentence`` tokens' worth), or,
where a sentence is long, inside it (``inside``). A window costs its padding plus ``window`` for being one more. With
positions p and the best cost f up to each,

    f(j) = price(j) + window + min over i with p(j) - p(i) <= size of f(i) + size - (p(j) - p(i))

so the transition is a sliding minimum of f(i) + p(i), kept in a monotone queue: every position enters and leaves it
once. Windows whose length is a power of two need no padding and are tried besides. A task holds one block of the
stream at a time; what the block's best cut leaves over starts the next. The rest at the end of a task is cut anywhere,
into powers of two if that is cheapest. No rows move between tasks, a retried task cuts the same stream alike, and
sequence ids carry the partition's number.

NULL and empty texts are documents of the separator alone. NULL ids stay NULL. Repeated rows are packed as often as
they occur. A text longer than a block makes a longer block. Other columns are ignored; an empty table has no pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.llm.common import slices, whole_text

_LOCAL_BITS = 40


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    size: int = 2048
    separator: int = 1
    sentence: float = 4.0
    inside: float = 32.0
    window: float = 8.0
    block: int = 64 * 2048
    #: A stretch without a boundary gets cuts inside it from this length on, this far apart.
    stretch: int = 256
    #: Chunks in each of the two generations a worker remembers, about 200 bytes each; it changes no id and no cut.
    memory: int = 250_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + n) for n, b in enumerate(hidden)}


class _Encoder(dict):
    """Ids of text as little-endian 32-bit bytes, by white-space chunks: no token of this tokenizer spans white space.

    The normaliser and the splitting pattern act inside a chunk only, so a chunk's ids do not depend on its context and
    are remembered. A full memory becomes the older generation; what is met again moves to the younger one. Words of
    Latin letters, which normalise to themselves in lower case and are one piece each, go straight to the merges, unless
    they are remembered in lower case without the marks behind them; other chunks run the whole tokenizer.
    """

    _latin = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
    #: str.split() splits at these, the tokenizer does not.
    _odd = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str, memory: int = Packing.memory):
        super().__init__()
        self.memory = memory
        from tokenizers import Tokenizer

        self.older: dict[str, bytes] = {}
        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model.tokenize
        self.letters = _byte_letters()
        ends = [i for t, i in self.whole.get_vocab().items() if re.search(r"[.!?](</w>)?$", t)]
        self.is_end = np.zeros(max(self.whole.get_vocab().values()) + 2, bool)
        self.is_end[ends] = True

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.merges(word)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        made = self.older.get(chunk)
        if made is None:
            word = chunk.rstrip(".,;:!?")
            if word.isascii() and word.isalpha() or self._latin.fullmatch(word):
                low = word.lower()
                made = self.get(low) or self.older.get(low) or self._word(low)
                if word != chunk:
                    made += self[chunk[len(word) :]]
            else:
                made = self._ids(chunk)
        if len(self) >= self.memory:
            self.older = dict(self)
            self.clear()
        self[chunk] = made
        return made

    def encode(self, text: str) -> bytes:
        if self._odd.search(text):
            return self._ids(text)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str, memory: int = Packing.memory) -> _Encoder:
    return _Encoder(path, memory)


def _positions(ids: np.ndarray, ends: np.ndarray, is_end: np.ndarray, p: Packing, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, and the price of each place."""
    price = np.full(len(ids) + 1, np.inf)
    if last:
        price[-p.size - 1 :] = p.inside
    price[1:][is_end[np.minimum(ids, len(is_end) - 1)]] = p.sentence
    price[ends] = 0.0
    price[0] = price[-1] = 0.0
    at = np.flatnonzero(np.isfinite(price))
    for i in np.flatnonzero(np.diff(at) > p.stretch):
        inner = np.arange(at[i] + p.stretch // 2, at[i + 1], p.stretch // 2)
        price[inner] = p.inside
    at = np.flatnonzero(np.isfinite(price))
    return at, price[at]


def choose_cuts(at: np.ndarray, price: np.ndarray, p: Packing, last: bool) -> list[int]:
    """The positions of the best cuts, from the first position on; ends at the last one only if ``last``."""
    exact: dict[int, list[int]] = {}
    size = p.size >> 1
    while size >= (1 if last else 64):
        i = np.searchsorted(at, at - size)
        for j in np.flatnonzero(at[np.minimum(i, len(at) - 1)] == at - size).tolist():
            exact.setdefault(j, []).append(int(i[j]))
        size >>= 1
    where, costs, full, none = at.tolist(), price.tolist(), p.size, ()
    best, came = [0.0] * len(where), [0] * len(where)
    level = [0.0] * len(where)  # best + where of the positions in the queue
    queue, head, tail = [0] * len(where), 0, 1
    level[0] = where[0]
    for j in range(1, len(where)):
        here = where[j]
        while where[queue[head]] < here - full:
            head += 1
        source = queue[head]
        cost = level[source] + full - here
        for i in exact.get(j, none):
            if best[i] < cost:
                cost, source = best[i], i
        cost += costs[j] + p.window
        best[j], came[j] = cost, source
        value = level[j] = cost + here
        while tail > head and level[queue[tail - 1]] >= value:
            tail -= 1
        queue[tail] = j
        tail += 1
    j = len(where) - 1
    if not last:  # the stream goes on: of the ends within one window the one reached at the least cost
        j = min((i for i in range(j, 0, -1) if where[i] > where[-1] - full), key=lambda i: (best[i], -i))
    cuts = [where[j]]
    while j:
        j = came[j]
        cuts.append(where[j])
    return cuts[::-1]


@dataclass
class _Stream:
    """The ids of a block and the documents they belong to."""

    ids: list[bytes] = field(default_factory=list)
    docs: list[tuple] = field(default_factory=list)  # doc_id, ids before the block, ids in the block, ids in all
    size: int = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.ids.append(ids)
        self.docs.append((doc_id, 0, n, n))
        self.size += n


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]
    + [("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded", pa.int64())]
)


def _cut_block(stream: _Stream, is_end: np.ndarray, p: Packing, sequence: int, last: bool) -> tuple[list[tuple], int, _Stream]:
    """Pieces of the block's windows, the next sequence number, and the stream that is left over."""
    raw = b"".join(stream.ids)
    ends = np.cumsum([d[2] for d in stream.docs])
    cuts = choose_cuts(*_positions(np.frombuffer(raw, "<u4"), ends, is_end, p, last), p, last)
    pieces, k, begin = [], 0, 0  # document k begins at ``begin``
    upto = ends.tolist()
    for a, b in zip(cuts, cuts[1:]):
        length = b - a
        padded = length if length & (length - 1) == 0 else p.size
        at = a
        while at < b:
            doc_id, before, _, total = stream.docs[k]
            stop = min(b, upto[k])
            pieces.append((doc_id, before + at - begin, stop - at, raw[4 * at : 4 * stop], total, sequence, at - a, padded))
            at = stop
            if stop == upto[k]:
                k, begin = k + 1, upto[k]
        sequence += 1
    rest = _Stream()
    if cuts[-1] < len(raw) // 4:
        doc_id, before, n, total = stream.docs[k]
        gone = cuts[-1] - begin
        rest.docs = [(doc_id, before + gone, n - gone, total), *stream.docs[k + 1 :]]
        rest.ids, rest.size = [raw[4 * cuts[-1] :]], len(raw) // 4 - cuts[-1]
    return pieces, sequence, rest


def pack(docs: DataFrame, p: Packing) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset in the sequence, and the length the sequence is padded to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(p.tokenizer, p.memory)
        sequence = TaskContext.get().partitionId() << _LOCAL_BITS
        end = np.array([p.separator], "<u4").tobytes()
        stream, pieces = _Stream(), []
        for rows in slices(batches):
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                stream.add(doc_id, words.encode(text) + end)
                if stream.size >= p.block:
                    made, sequence, stream = _cut_block(stream, words.is_end, p, sequence, last=False)
                    pieces += made
                    if len(pieces) > 2000:
                        yield _table(pieces)
                        pieces = []
        if stream.size:
            made, sequence, _ = _cut_block(stream, words.is_end, p, sequence, last=True)
            pieces += made
        if pieces:
            yield _table(pieces)

    kinds = {"int64": "long", "binary": "binary"}
    schema = ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in _SCHEMA)
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, schema)


def _table(pieces: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces), _SCHEMA)], schema=_SCHEMA)
