"""Periodic runs of words, found through Lyndon roots, and texts collapsed to one period of each run.

A run is a stretch of words with least period q that cannot be extended and holds at least ``exponent`` periods and
``least`` words. Every run has a place where the longest Lyndon word, under some order of the words or under its
reverse, is one period of the run. So per document:

1. Runs can only lie where short sequences of words repeat within the document; the other words are left out.
2. Phase one of Baier's suffix sorter groups the suffixes by their longest Lyndon prefix, from the greatest group down,
   once under each of both orders; it yields the two Lyndon arrays directly, without a suffix array.
3. Each Lyndon word is extended to both sides as far as words one period apart agree (longest common extensions through
   names of equal blocks); what is long enough is a run.

Everything is exact, and linear in the words but for the sorting of block names. A document is one unit of work: what
is kept of its repeating words, times their logarithm, has to fit into a task.

NULL texts have no words. A text without runs keeps its words; words of a collapsed text are joined by one space. A NULL
doc_id or a repeated one makes no difference, every row is treated alone. Other columns of the input are ignored; an
empty table gives no rows. Runs of equal length come by start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.llm import blocks
from evidrank.llm.common import whole_text

LEAST, EXPONENT = 6, 4
#: Repeating words that are gathered from several documents before they are searched together.
_GATHER = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lyndon_lengths(ranks: list[int], symbols: int) -> list[int]:
    """Length of the longest Lyndon word from each place on; ranks are 0..symbols-1, each in use.

    Suffixes are grouped by the Lyndon prefix known so far, at first their first word; groups stand in order. The
    greatest group is final: its members are taken out of the chain of places, and the length of each is the distance
    to its successor in the chain. The predecessor of a member gets the member's prefix appended: predecessors leave
    their group upwards, those that took more members the higher.
    """
    n = len(ranks)
    before, after = list(range(-1, n)), [*range(1, n + 1), 0]  # one cell more for the place -1 or n
    members: list[list[int]] = [[] for _ in range(symbols)]
    for at, rank in enumerate(ranks):
        members[rank].append(at)
    group, size = list(ranks), [len(m) for m in members]
    lower, upper = list(range(-1, symbols - 1)), [*range(1, symbols), -1]
    lengths = [0] * n
    top = symbols - 1
    while top >= 0:
        taken: dict[int, int] = {}
        for at in members[top]:
            if group[at] == top:
                left, right = before[at], after[at]
                lengths[at] = right - at
                after[left] = right
                before[right] = left
                if left >= 0:
                    taken[left] = taken.get(left, 0) + 1
        members[top] = []
        if len(taken) == 1:
            (left,) = taken
            moves = [] if size[group[left]] == 1 else [((group[left], 1), [left])]
        else:
            sets: dict[tuple[int, int], list[int]] = {}
            for left, times in taken.items():
                sets.setdefault((group[left], times), []).append(left)
            moves = sorted(sets.items())
        last, below = -1, -1
        for (old, _), moved in moves:
            if old != last:
                last, below = old, old
                if len(moved) == size[old]:
                    continue  # the whole group moves: its place among the others stays
            new = len(members)
            members.append(moved)
            size.append(len(moved))
            size[old] -= len(moved)
            for at in moved:
                group[at] = new
            over = upper[below]
            lower.append(below)
            upper.append(over)
            lower[over] = upper[below] = new
            below = new
        top = lower[top]
    return lengths


def runs_of(symbols: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of numbers, in that order."""
    names = blocks.doubled(symbols)
    if not names:
        return []
    ranks, count, found = names[0], int(names[0].max()) + 1, set()
    room = 2 if exponent >= 3 else 1  # of three periods or more, some root has another after it
    for order in (ranks, count - 1 - ranks):
        period = np.array(lyndon_lengths(order.tolist(), count), np.int64)
        at = np.flatnonzero(np.arange(len(period)) + room * period <= len(period))
        if room == 2:
            at = at[ranks[at] == ranks[at + period[at]]]
        period = period[at]
        ahead, back = blocks.common_after(names, at, at + period), blocks.common_before(names, at, at + period)
        length = ahead + back + period
        long = (length >= least) & (length >= exponent * period)
        found.update(zip((at - back)[long].tolist(), length[long].tolist(), period[long].tolist()))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeating(symbols: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Which places belong to a sequence of g words that occurs twice, where g is the most that every place of a run does."""
    g = max(1, least - -(-least // exponent) - 1)
    covered = np.zeros(len(symbols) + 1, np.int64)
    if len(symbols) < least:
        return covered[:-1] > 0
    n = len(symbols) - g + 1
    with np.errstate(over="ignore"):
        mixed = np.zeros(n, np.uint64)
        for k in range(g):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + symbols[k : k + n].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    covered[twice] += 1
    covered[twice + g] -= 1
    return covered[:-1].cumsum() > 0


def _stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]


def document_runs(texts: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several lists of words; repeating stretches of all of them are searched as one sequence."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    pieces: list[np.ndarray] = []
    origin: list[tuple[int, int, int]] = []  # (where the piece begins, document, word)
    filled = 0

    def search() -> None:
        nonlocal filled
        if pieces:
            starts = np.array([o[0] for o in origin])
            for start, length, period in runs_of(np.concatenate(pieces), least, exponent):
                at, doc, word = origin[int(np.searchsorted(starts, start, "right")) - 1]
                found[doc].append((start - at + word, length, period))
        pieces.clear()
        origin.clear()
        filled = 0

    for doc, words in enumerate(texts):
        if len(words) < least:
            continue
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        symbols = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        for a, b in _stretches(repeating(symbols, least, exponent), least):
            origin.append((filled, doc, a))
            pieces.append(symbols[a:b])
            pieces.append(np.array([-1 - filled]))  # occurs once, so no run reaches over it
            filled += b - a + 1
        if filled >= _GATHER:
            search()
    search()
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = change[:-1].cumsum() == 0
    return b" ".join([w for w, k in zip(words, keep.tolist()) if k])


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and the collapsed text of every row. Map-only."""
    if least < 2 or exponent < 2:
        raise ValueError("a run needs two words and two periods at least")
    schema = pa.schema([("doc_id", pa.int64()), ("runs", _FOUND), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [t.split() for t in rows.column(1).to_pylist()]  # of bytes: ASCII white space only
            found = document_runs(texts, least, exponent)
            listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], _FOUND)
            kept = pa.array([collapsed(w, r).decode("utf-8", "replace") for w, r in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), listed, kept], schema=schema)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return read.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
