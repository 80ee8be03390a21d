"""Exact top-k inner products through a pivot-distance index.

Vectors are integer: floor(``scale`` * component). With M the largest squared length, a vector x gets one more
component sqrt(M - |x|^2), a query 0; then |q - x|^2 = |q|^2 + M - 2 q.x, the best products are the nearest points, and
the triangle inequality holds: |d(q, p) - d(x, p)| <= d(q, x) for any pivot p.

Index: every vector is keyed by its nearest pivot and the distance to it; sorted by both it is cut into annuli of at
most ``block`` vectors. Pivots are a bounded sample (``pivots``); they decide the work, never the result.
Search: queries travel in chunks of at most ``chunk``. A chunk first meets the annulus around its own distance, which
gives every query a k-th product and so a radius; then it meets those annuli, of all pivots, that the radius reaches.
Chunks and annuli meet in groups, each read once for all its pairs; products below the k-th one known stay in the task.
Bounds have slack for rounding; products are exact integers.

Equal vectors are indexed once, with the k + 1 smallest ids that hold them: no query can return more of them. Equal
queries are searched once. Rows whose vec_id, vector or any component is NULL, or whose components are not all finite,
take no part. Of rows that repeat a vec_id the one with the smallest vector counts. Shorter vectors count as padded
with zeros. Other columns are ignored; an empty table gives no rows. Products beyond 64 bits wrap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrank.llm.common import batch, settled, slices

_SLACK = 1e-7


@dataclass(frozen=True)
class Search:
    k: int = 20
    scale: float = 64.0
    pivots: int = 32
    block: int = 4096
    chunk: int = 256


def quantised(vectors: DataFrame, scale: float, vector: str = "embedding") -> DataFrame:
    """vec_id, key (the integer components, little-endian 64-bit) and length2 of every vector that takes part."""
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.binary()), ("length2", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sizes = rows.column(1).value_lengths().to_numpy()
            x = np.zeros((len(sizes), max(1, sizes.max())))
            x[np.arange(x.shape[1]) < sizes[:, None]] = np.floor(rows.column(1).flatten().to_numpy() * scale)
            whole = np.clip(x, -(2.0**62), 2.0**62).astype("<i8")
            ends = np.where(whole != 0, np.arange(1, x.shape[1] + 1), 0).max(axis=1)  # zeros at the end are padding
            yield batch(schema, rows.column(0), [row[:n].tobytes() for row, n in zip(whole, ends.tolist())], (x * x).sum(axis=1))

    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    return rows.select(F.col("vec_id").cast("long"), x.cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, key binary, length2 double")


def _matrix(keys: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(key.ljust(8 * width, b"\0") for key in keys), "<i8").reshape(len(keys), width)


def _exact(a: list[np.ndarray], b: list[np.ndarray]) -> type:
    """The fastest type in which no product of a row of ``a`` with a row of ``b`` is rounded."""
    most = lambda ms: max((float(np.abs(m.astype(np.float64)).max(initial=0)) for m in ms), default=0)
    bound = most(a) * most(b) * max((m.shape[1] for m in b), default=0)
    return np.float32 if bound < 2.0**24 else np.float64 if bound < 2.0**53 else np.int64


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    a, b = np.column_stack([x, extra]).astype(np.float64), np.column_stack([pivots, pivot_extra]).astype(np.float64)
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0))


@dataclass(frozen=True)
class _Space:
    """What every task needs: the pivots (a bounded sample), the largest squared length and the width."""

    pivots: np.ndarray
    extra: np.ndarray
    most: float
    width: int

    def distances(self, x: np.ndarray, indexed: bool) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.most - (x.astype(np.float64) ** 2).sum(1), 0)) if indexed else np.zeros(len(x))
        return _distances(x, extra, self.pivots, self.extra)


def _space(distinct: DataFrame, p: Search) -> _Space | None:
    most, width = distinct.agg(F.max("length2"), F.max(F.octet_length("key"))).first()
    if most is None:
        return None
    sample = distinct.orderBy(F.xxhash64("key"), "key").limit(p.pivots).select("key").collect()
    width = max(1, width // 8)
    pivots = _matrix([bytes(r[0]) for r in sample], width)
    extra = np.sqrt(np.maximum(most - (pivots.astype(np.float64) ** 2).sum(1), 0))
    return _Space(pivots, extra, most, width)


def _nearest(rows: DataFrame, space: _Space, indexed: bool) -> DataFrame:
    """key, its nearest pivot and the distance, and the other columns."""
    names = [c for c in rows.columns if c != "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                d = space.distances(_matrix(part.column(0).to_pylist(), space.width), indexed)
                near = d.argmin(axis=1)
                made = [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "pivot", "distance"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("key", *names).schema.fields)
    return rows.select("key", *names).mapInArrow(run, f"{fields}, pivot int, distance double")


_BLOCK_SQL = "block long, pivot int, lo double, hi double, keys array<binary>, ids array<array<long>>"
_BLOCK = pa.schema(
    [("block", pa.int64()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]
    + [("keys", pa.list_(pa.binary())), ("ids", pa.list_(pa.list_(pa.int64())))]
)


def _annuli(rows: DataFrame, size: int) -> DataFrame:
    """Rows of at most ``size`` vectors of one pivot with neighbouring distances: ranges, sorted, then cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal number, held
            pivot, d, keys, ids = zip(*held)
            one = [[number], [pivot[0]], [d[0]], [d[-1]], [list(keys)], [list(ids)]]
            number, held = number + 1, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, _BLOCK)], schema=_BLOCK)

        for part in batches:
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if held and (len(held) == size or held[-1][0] != row[0]):
                    yield block()
                held.append(row)
        if held:
            yield block()

    order = ["pivot", "distance", "key"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("pivot", "distance", "key", "ids")
    return settled(dealt.mapInArrow(run, _BLOCK_SQL))


#: chunk, the query's place in it, a product and the ids that hold the vector.
_FOUND = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("score", pa.int64()), ("ids", pa.list_(pa.int64()))])
_FOUND_SQL = "chunk long, at int, score long, ids array<long>"
#: Bytes of annuli and of chunks that meet as one group: each is read once for all pairs of the group.
_ANNULI_BYTES, _CHUNKS_BYTES = 16 << 20, 4 << 20
_UNKNOWN = np.iinfo(np.int64).min


class _Best:
    """The ``most`` best vectors of every query of a chunk so far; ``least`` is the last one's score where known."""

    def __init__(self, least: np.ndarray, most: int):
        self.least, self.most = least, most
        self.at, self.score, self.vector = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, start: int, first: np.ndarray) -> None:
        """Scores of queries by vectors, which are numbered from ``start``; ties go to the smaller of their ``first`` ids."""
        unknown = self.least == _UNKNOWN
        if scores.shape[1] >= self.most and unknown.any():
            self.least[unknown] = np.partition(scores[unknown], -self.most, axis=1)[:, -self.most]
        at, vector = np.divmod(np.flatnonzero(scores >= self.least.astype(scores.dtype)[:, None]), scores.shape[1])
        score = np.concatenate([self.score, scores[at, vector].astype(np.int64)])
        at, vector = np.concatenate([self.at, at]), np.concatenate([self.vector, start + vector])
        order = np.lexsort((first[vector], ~score, at))
        at, score, vector = at[order], score[order], vector[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        last, kept = place == self.most - 1, place < self.most
        self.least[at[last]] = score[last]
        self.at, self.score, self.vector = at[kept], score[kept], vector[kept]


def _meet(pairs: DataFrame, chunks: DataFrame, blocks: DataFrame, width: int, p: Search) -> DataFrame:
    """chunk, the query's place in it, score and vec_id: of the annuli that a chunk meets, what can be among the k + 1 best.

    ``chunks`` has chunk, keys and ``known``, scores that k + 1 vectors reach already: what is below is left out.
    """

    def run(asked: pa.Table, met: pa.Table) -> pa.Table:
        numbers = met.column("block").to_pylist()
        against = [_matrix(keys.as_py(), width) for keys in met.column("keys")]
        starts = np.cumsum([0, *map(len, against)]).tolist()
        ids = pa.concat_arrays([row.values for row in met.column("ids")])
        first = pc.list_element(ids, 0).to_numpy()
        queries = [_matrix(keys.as_py(), width) for keys in asked.column("keys")]
        exact = _exact(queries, against)
        against = [m.astype(exact).T for m in against]
        made = []
        for chunk, meets, known, q in zip(asked.column("chunk").to_pylist(), asked.column("meets").to_pylist(), asked.column("known").to_pylist(), queries):
            least = np.full(len(q), _UNKNOWN)
            for r in known or ():
                least[r["at"]] = r["score"]
            best = _Best(least, p.k + 1)
            for i, number in enumerate(numbers):
                if number in meets:
                    best.add(q.astype(exact) @ against[i], starts[i], first)
            made.append(batch(_FOUND, np.full(len(best.at), chunk), best.at, best.score, ids.take(pa.array(best.vector))))
        return pa.Table.from_batches(made, _FOUND)

    def group(name: str, table: DataFrame, size: int, most: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(1 + table.count() * size * width * 8 // most)).alias(f"{name}s")

    group_by = [group("chunk", chunks, p.chunk, _CHUNKS_BYTES), group("block", blocks, p.block, _ANNULI_BYTES)]
    pairs = pairs.select("chunk", "block", *group_by)
    asked = pairs.groupBy("chunks", "blocks", "chunk").agg(F.collect_list("block").alias("meets")).join(chunks, "chunk")
    sent = pairs.select(F.col("chunks").alias("to"), F.col("blocks").alias("of"), "block").distinct()
    met = sent.join(blocks.select("block", "keys", "ids"), "block")
    found = asked.groupBy("chunks", "blocks").cogroup(met.groupBy("to", "of")).applyInArrow(run, _FOUND_SQL)
    return found.select("chunk", "at", "score", F.explode("ids").alias("vec_id"))


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of every query, numbered from 1."""
    ranked = Window.partitionBy("chunk", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= most)


def _reach(chunks: DataFrame, space: _Space) -> DataFrame:
    """chunk, pivot and the distances from it between which a better vector could lie, over the chunk's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for chunk, keys, known in zip(*(c.to_pylist() for c in part.columns)):
                x = _matrix(keys, space.width)
                length2 = (x.astype(np.float64) ** 2).sum(1)
                least = np.full(len(keys), -np.inf)
                for r in known or ():
                    least[r["at"]] = r["score"]
                radius = np.sqrt(np.maximum(length2 + space.most - 2 * least, 0))
                slack = _SLACK * (1 + np.sqrt(length2 + space.most))
                d = space.distances(x, indexed=False)
                low, high = (d - (radius + slack)[:, None]).min(0), (d + (radius + slack)[:, None]).max(0)
                n = len(low)
                names = ["chunk", "pivot", "low", "high"]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(low), pa.array(high)], names=names)

    return chunks.select("chunk", "keys", "known").mapInArrow(run, "chunk long, pivot int, low double, high double")


def top_k(vectors: DataFrame, is_query: Column, p: Search = Search()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best products of every query row, its own row left out."""
    rows = quantised(vectors, p.scale).groupBy("vec_id").agg(F.min(F.struct("key", "length2")).alias("v"))
    rows = settled(rows.select("vec_id", "v.key", "v.length2"))
    first = Window.partitionBy("key").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= p.k + 1)
    distinct = settled(few.groupBy("key").agg(F.min("length2").alias("length2"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    space = _space(distinct, p)
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "key")
    if space is None:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    blocks = _annuli(_nearest(distinct, space, indexed=True), p.block)
    asked = queries.select("key").distinct().withColumn("ids", F.array().cast("array<long>"))
    chunks = _annuli(_nearest(asked, space, indexed=False), p.chunk).withColumnRenamed("block", "chunk")
    # Chunks and annuli are keyed by the same pivots; a chunk's own annulus is the one nearest to its distances.
    c = chunks.select("chunk", "pivot", F.col("lo").alias("from"), F.col("hi").alias("to"))
    b = blocks.select("block", "pivot", "lo", "hi")
    gap = F.greatest(F.col("lo") - F.col("to"), F.col("from") - F.col("hi"), F.lit(0.0))
    home = c.join(b, "pivot").groupBy("chunk").agg(F.min(F.struct(gap.alias("gap"), "block")).alias("near"))
    home = settled(home.select("chunk", "near.block"))
    chunks = chunks.select("chunk", "keys")
    nothing = F.lit(None).cast("array<struct<at:int,score:long>>").alias("known")
    found = settled(_ranked(_meet(home, chunks.select("*", nothing), blocks, space.width, p), p.k + 1))
    kth = found.where(F.col("n") == p.k + 1).groupBy("chunk")  # a chunk's queries at most
    chunks = settled(chunks.join(kth.agg(F.collect_list(F.struct("at", "score")).alias("known")), "chunk", "left"))
    more = _reach(chunks, space).join(b, "pivot").where((F.col("hi") >= F.col("low")) & (F.col("lo") <= F.col("high")))
    more = settled(more.select("chunk", "block").join(home, ["chunk", "block"], "left_anti"))
    found = found.drop("n").unionByName(_meet(more, chunks, blocks, space.width, p))
    best = _ranked(found, p.k + 1)
    lists = best.groupBy("chunk", "at").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    keys = chunks.select("chunk", F.posexplode("keys").alias("at", "key"))
    # A table of its own, so that a vector that a third of the queries share can be split over tasks in the join.
    own = queries.join(settled(lists.join(keys, ["chunk", "at"]).select("key", "best")), "key")
    kept = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, p.k)
    out = own.select("query_id", F.posexplode(kept).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
