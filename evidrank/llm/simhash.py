"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming distance.

Links are found by the generalised pigeonhole principle. The 64 bits are grouped into m parts with thresholds t_1..t_m,
sum(t_i + 1) = distance + 1: two fingerprints within the distance are within t_i in some part i (t_i = -1 leaves a part
out). Correlated bits go into the same part, and a dynamic programme gives each part its threshold so that the rows
probed plus the candidates expected are fewest. Every fingerprint is indexed once per part and probes each part with
all values within t_i; the distance itself is checked inside the join, so only true links leave it. Nothing is capped:
the plan changes how many rows are compared, never which links are found.

Copies meet first: the join and the components run over distinct fingerprints. At a distance of 4 the neighbours of
one fingerprint are bounded by geometry, however many documents there are.

NULL texts count as empty; a text without words has fingerprint 0 and links like any other. A row with a NULL doc_id
gets a fingerprint and a component; NULL is never the smallest id unless the component has no other. Repeated rows
share a component. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrank.llm.common import batch, settled, slices, whole_text

BITS, SEED = 64, 42
#: Rows of bits that are counted at a time.
_CHUNK = 1 << 16
#: Cost of one compared candidate against one probed row (sorted, shuffled).
_CANDIDATE = 0.05


def fingerprint(text: bytes, width: int = 4) -> int:
    """Majority of the bits of XXH64 over the word shingles of a UTF-8 text; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line, n = b" ".join(words), len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        upto = min(n, at + _CHUNK)
        spans = zip(starts[at:upto].tolist(), ends[at + width - 1 : upto + width - 1].tolist())
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, text_key (64-bit hash of the text) and the fingerprint as a signed long, for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            prints = [fingerprint(t, width) for t in rows.column(2).to_pylist()]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), signed], schema=schema)

    text = whole_text()
    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.cast("binary"))
    return read.mapInArrow(run, "doc_id long, text_key long, bits long")


# -- plan of the parts ---------------------------------------------------------------------------------------------


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits how many have both set: at most 64 x 64 numbers."""
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS + 1, BITS + 1), np.int64)
        for rows in batches:
            values = rows.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(values), _CHUNK):
                part = values[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32)
                bits = np.hstack([bits, np.ones((len(bits), 1), np.float32)])
                both += (bits.T @ bits).astype(np.int64)
        a, b = np.nonzero(both)
        yield batch(schema, a, b, both[a, b])

    sums = prints.select("bits").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = np.zeros((BITS + 1, BITS + 1))
    for a, b, n in sums.collect():
        both[a, b] = n
    return int(both[BITS, BITS]), both[:BITS, :BITS]


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each grows by the bit most correlated with it."""
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        if len(left) <= width:
            groups.append(sorted(left))
            break
        rest = sorted(left)
        first = max(rest, key=lambda b: (max(corr[b, c] for c in rest if c != b), -b))
        group = [first]
        left.discard(first)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def agreement(both: np.ndarray, n: int, group: Sequence[int], most: int) -> list[float]:
    """Chance that two fingerprints differ in at most t = 0..most bits of the group.

    The number of differing bits is taken as a sum of independent ones with the measured rates, times how much more
    often neighbouring bits of the group agree together than apart.
    """
    p = both.diagonal() / n
    differ = 2 * p * (1 - p)
    chances = np.zeros(most + 1)
    chances[0] = 1.0
    for b in group:
        chances[1:] = chances[1:] * (1 - differ[b]) + chances[:-1] * differ[b]
        chances[0] *= 1 - differ[b]
    for a, b in zip(group, group[1:]):
        joint = np.array([both[a, b], both[a, a] - both[a, b], both[b, b] - both[a, b]]) / n
        together = (joint**2).sum() + (1 - joint.sum()) ** 2
        chances *= together / ((1 - differ[a]) * (1 - differ[b]))
    return np.minimum(1, chances.cumsum()).tolist()


def ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def allot(costs: Sequence[Sequence[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = total and the least cost; costs[i][t + 1], where t = -1 skips part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t1, more in enumerate(own[: total - used + 1]):
                if used + t1 not in step or cost + more < step[used + t1][0]:
                    step[used + t1] = (cost + more, [*chosen, t1 - 1])
        best = step
    return best[total]


def plan_parts(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is used, the cheapest over every number of parts up to distance + 1."""
    if not n:
        return []
    p = both.diagonal() / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    options = []
    for parts in range(1, distance + 2):
        groups = group_bits(corr, parts)
        costs = []
        for g in groups:
            chance = agreement(both, n, g, distance)
            index = [n * (1 + ball(len(g), t)) + _CANDIDATE * chance[t] * n * n / 2 for t in range(distance + 1)]
            costs.append([0.0, *index])
        cost, chosen = allot(costs, distance + 1)
        options.append((cost, parts, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


# -- links and components ------------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _flips(bits: tuple[int, ...], radius: int) -> tuple[int, ...]:
    """Every mask with at most ``radius`` of the bits set, as signed longs."""
    return tuple(_signed(sum(1 << b for b in some)) for k in range(radius + 1) for some in combinations(bits, k))


def _mask(bits: Sequence[int]) -> Column:
    return F.lit(_signed(sum(1 << b for b in bits)))


def _near(group: Sequence[int], radius: int) -> Column:
    """The group's bits of the fingerprint and all values within the radius of them."""
    own = F.col("bits").bitwiseAND(_mask(group))
    return F.transform(F.lit(list(_flips(tuple(group), radius))), lambda flip: own.bitwiseXOR(flip))


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Every pair a < b of distinct fingerprints (column ``bits``) that differ in at most ``distance`` bits."""
    plan = plan_parts(*bit_counts(prints), distance)
    if not plan:
        return prints.select(F.col("bits").alias("a"), F.col("bits").alias("b")).limit(0)
    own = F.array(*[F.col("bits").bitwiseAND(_mask(g)) for g, _ in plan])
    near = F.array(*[_near(g, t) for g, t in plan])
    index = prints.select(F.col("bits").alias("a"), F.posexplode(own).alias("part", "value"))
    probe = prints.select(F.col("bits").alias("b"), F.posexplode(near).alias("part", "values"))
    probe = probe.select("b", "part", F.explode("values").alias("value"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    on = (index["part"] == probe["part"]) & (index["value"] == probe["value"]) & close
    return index.join(probe, on).select("a", "b").distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """node, root: the end of the chain of parents, by pointer jumping. Parents are smaller than their nodes."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = parents.join(up, "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        jumped = settled(jumped)
        parents = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return parents


def components(pairs: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over the links, for every node that has one.

    Each round hooks every node onto its smallest neighbour, follows the hooks to their ends and contracts the graph:
    links now run between ends, and those within one end vanish, so dense groups shrink in the first round. Rounds are
    tables in the shared folder: no lineage grows, and a lost executor costs one round at most.
    """
    edges = settled(pairs.select("a", "b"))
    both = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = settled(both.select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        # Links run from the smaller node a to the larger b: the least a is the least neighbour of b.
        ends = _roots(settled(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))))
        of = lambda c: ends.select(F.col("node").alias(c), F.col("root").alias(f"{c}_end"))
        moved = edges.join(of("b"), "b").join(of("a"), "a", "left").select(F.coalesce("a_end", "a").alias("x"), F.col("b_end").alias("y"))
        moved = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = settled(moved.distinct())
        labels = settled(labels.join(of("root"), "root", "left").select("node", F.coalesce("root_end", "root").alias("root")))
    return labels


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, text_key, bits, component_id (smallest doc_id reachable) and component_key (its smallest fingerprint)."""
    prints = settled(fingerprints(docs, width))
    distinct = settled(prints.groupBy("bits").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct, distance))
    keyed = distinct.join(roots, distinct["bits"] == roots["node"], "left")
    keyed = settled(keyed.select("bits", "first_id", F.coalesce("root", "bits").alias("component_key")))
    ids = settled(keyed.groupBy("component_key").agg(F.min("first_id").alias("component_id")))
    known = settled(keyed.join(ids, "component_key").select("bits", "component_id", "component_key"))
    return prints.join(known, "bits").select("doc_id", "text_key", "bits", "component_id", "component_key")


def text_links(groups: DataFrame) -> DataFrame:
    """The groups of ``near_duplicates`` as links a < b of text keys: each text with the smallest key of its group."""
    texts = settled(groups.groupBy("component_key", "text_key").agg(F.lit(1).alias("_one")).select("component_key", "text_key"))
    hubs = settled(texts.groupBy("component_key").agg(F.min("text_key").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return texts.join(hubs, "component_key").where("a < text_key").select("a", F.col("text_key").alias("b"))


def keep_first(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs``, one per component: of its smallest doc_id the row whose text has the smallest hash."""
    return first_of_each(docs, near_duplicates(docs.select("doc_id", "text"), width, distance))


def first_of_each(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their component; ``known`` has doc_id, text_key and component_key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")).alias("first")
    kept = settled(known.groupBy("component_key").agg(first).select("first.doc_id", "first.text_key").distinct())
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole_text()).alias("_key"))
    rows = plain.join(kept, plain["_id"].eqNullSafe(kept["doc_id"]) & (plain["_key"] == kept["text_key"]), "left_semi")
    once = Window.partitionBy("_id", "_key").orderBy(F.lit(0))
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def hex_digits(bits: Column) -> Column:
    """16 lower-case hex digits of a long taken as unsigned."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
