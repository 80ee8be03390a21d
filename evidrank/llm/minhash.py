"""Document fingerprints: MinHash signatures over word shingles, compared, banded, joined and verified.

A signature holds, for each of ``permutations`` universal hash functions (a * h + b mod 2**64, upper bits), the least
value over the text's shingles of ``width`` words; all functions run over blocks of shingles in numpy. Words are runs
of characters other than ASCII white space, A-Z lower-cased; a text with fewer words is one shingle. The share of equal
places estimates the Jaccard similarity of two shingle sets.

``similar`` finds near-duplicates: signature bands joined, Jaccard verified. ``compare_with_next`` gives every document
its fingerprint and compares it with an edited text and with the next document.

NULL texts count as empty. Empty texts share one fingerprint and are alike. A NULL doc_id sorts first. Rows that repeat
a doc_id are ordered by text. Other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrank.functions import ranks
from evidrank.functions.joins import spread_width
from evidrank.llm.common import append, settled, whole_text
from evidrank.llm.simhash import components

PERMUTATIONS, WIDTH, SIMILARITY = 128, 5, 0.8
#: Two texts of similarity 0.8 share one of the bands with a chance of 0.99995.
BANDS, ROWS = 25, 5
#: Rounds in which the texts of a band meet a leader.
LEADERS = 4
_BLOCK = 512
_EMPTY = np.full(PERMUTATIONS, 0xFFFF, np.uint16)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.Generator(np.random.PCG64(20_240_229)).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return (draws[0] << np.uint64(1)) | np.uint64(1), draws[1] << np.uint64(1)


_A, _B = _functions(PERMUTATIONS)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(32)


class _Words(dict):
    """Hash of a word; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; of the whole if there are fewer."""
    n = max(1, len(words) - width + 1) if len(words) else 0
    with np.errstate(over="ignore"):
        mixed = np.zeros(n, np.uint64)
        for k in range(min(width, len(words))):
            mixed = (mixed ^ (mixed >> _LOW)) * _MIX + words[k : k + n]
        return (mixed ^ (mixed >> _LOW)) * _MIX


def _lowest(hashes: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Least value of every function over the shingles, from ``start`` on."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64) if start is None else start.copy()
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), _BLOCK):
            values = hashes[at : at + _BLOCK] * _A[:, None]
            values += _B[:, None]
            np.minimum(low, values.min(axis=1), out=low)
    return low


def _signature(low: np.ndarray, empty: bool) -> np.ndarray:
    """16 bits a place: the bits below the top ones, which the minimum leaves near zero, hashed together with them."""
    if empty:
        return _EMPTY
    with np.errstate(over="ignore"):
        return ((low >> _LOW) * _MIX >> np.uint64(48)).astype(np.uint16)


def signature(text: str) -> np.ndarray:
    hashes = shingles(word_hashes(text))
    return _signature(_lowest(hashes), not len(hashes))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / PERMUTATIONS


def both_signatures(text: str, edited: str) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a text and of its edited form; what they begin with in common is hashed once."""
    a, b = word_hashes(text), word_hashes(edited)
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    same = max(0, (int(differ[0]) if len(differ) else n) - WIDTH + 1)
    x, y = shingles(a), shingles(b)
    if not same or not len(x) or not len(y):
        return _signature(_lowest(x), not len(x)), _signature(_lowest(y), not len(y))
    shared = _lowest(x[:same])
    return _signature(_lowest(x[same:], shared), False), _signature(_lowest(y[same:], shared), False)


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next document's first ones, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def written(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


# -- a document and the next one -----------------------------------------------------------------------------------


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, ahead, doc_id, text), dealt and sorted so that a row's next document is the row below it.

    Ids are cut into ranges by a bounded list of quantiles. Every range also gets, marked ``ahead``, a copy of the
    document with which the next range that has any begins (the last range: of the very first). One shuffle of the
    texts, and no order over the whole table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    bounds = ranks.measure_bounds(rows, {"id": "doc_id"})["id"]
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(bounds.bucket(F.col("doc_id"))).cast("int")
    rows = rows.withColumn("part", part)
    starts = rows.groupBy("part").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("missing"))
    begins = sorted(starts.collect())  # one row per range
    goes_to = [(b["part"], None if b["missing"] else b["first"], begins[i - 1]["part"]) for i, b in enumerate(begins)]
    known = rows.sparkSession.createDataFrame(goes_to, "part int, first long, goes_to int")
    rows = rows.join(F.broadcast(known), "part")
    own = F.struct("part", F.lit(False).alias("ahead"))
    copied = F.struct(F.col("goes_to").alias("part"), F.lit(True).alias("ahead"))
    at = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(own, copied)).otherwise(F.array(own))
    rows = rows.select("doc_id", "text", F.inline(at))
    n = spread_width(docs)
    dealt = rows.repartitionById(n, F.pmod(F.col("part"), F.lit(n)).cast("int"))
    return dealt.sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text").select("part", "ahead", "doc_id", "text")


_COMPARED = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_COMPARED_SQL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double"
)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how alike the edited text and the next document are."""

    def finished(row: tuple, text: str) -> tuple[tuple, np.ndarray]:
        """The output for (id, text) followed by ``text``, but for near_next, and the document's own signature."""
        doc_id, own = row
        edited = edit(own, text)
        mine, theirs = both_signatures(own, edited)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, len(own), digest, written(mine), written(theirs), likeness(mine, theirs)), mine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, part, made, late = None, None, [], None  # late: the output that lacks its next document's signature
        for rows in batches:
            for at, ahead, doc_id, text in zip(*(c.to_pylist() for c in rows.columns)):
                if waiting is not None and at == part:
                    done, mine = finished(waiting, text)
                    if late is not None:
                        made.append((*late[0], likeness(late[1], mine)))
                    late = (done, mine)
                    if ahead:
                        made.append((*late[0], likeness(late[1], signature(text))))
                        late = None
                part, waiting = at, None if ahead else (doc_id, text)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _COMPARED)], schema=_COMPARED)
                made = []

    return with_next(docs).mapInArrow(run, _COMPARED_SQL)


# -- near-duplicates -----------------------------------------------------------------------------------------------


def band_keys(sig: np.ndarray) -> list[int]:
    """One 64-bit key per band of the signature, signed."""
    return [xxhash.xxh64_intdigest(sig[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def sketch(sig: np.ndarray) -> tuple[int, int]:
    """One bit of each of the 128 places: two signatures differ in half of the places where their minima differ."""
    low, high = np.packbits((sig & 1).astype(np.uint8)).view("<i8").tolist()
    return low, high


def _banded(plain: DataFrame) -> DataFrame:
    """text_key, n (size of the shingle set), the sketch (low, high) and bands of every different text of (text_key, text)."""

    def banded(texts: list[str]) -> list[pa.Array]:
        keys, sizes, bits = [], [], []
        for t in texts:
            hashes = shingles(word_hashes(t))
            sig = _signature(_lowest(hashes), not len(hashes))
            keys.append(band_keys(sig))
            sizes.append(len(np.unique(hashes)))
            bits.append(sketch(sig))
        low, high = zip(*bits) if bits else ((), ())
        return [pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())]

    rows = append(plain, banded, {"bands": "array<long>", "n": "long", "low": "long", "high": "long"})
    one = F.min(F.struct("n", "low", "high", "bands")).alias("s")  # equal texts have equal ones
    return rows.groupBy("text_key").agg(one).select("text_key", "s.*")


def _sets(plain: DataFrame, asked: DataFrame) -> DataFrame:
    """text_key and grams, the shingle set as 32-bit hashes, of the texts in ``asked``."""

    def listed(texts: list[str]) -> list[pa.Array]:
        sets = [np.unique((shingles(word_hashes(t)) >> _LOW).astype(np.uint32)).view(np.int32) for t in texts]
        return [pa.array(sets, pa.list_(pa.int32()))]

    met = plain.join(asked, "text_key", "left_semi")
    made = append(met, listed, {"grams": "array<int>"})
    return settled(made.groupBy("text_key").agg(F.min("grams").alias("grams")))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of text keys whose shingle sets are as similar as ``least``."""
    of = lambda c: sets.select(F.col("text_key").alias(c), F.col("grams").alias(f"{c}_grams"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    true = shared >= F.lit(least) * (F.size("a_grams") + F.size("b_grams") - shared)
    return settled(met.where(true).select("a", "b"))


def _hooked(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels (node, root) after one step: every root joins the smallest root it is linked to.

    Not yet components, but enough to leave out most pairs that are in one; those are found once, at the end.
    """
    of = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    met = found.join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root")
    up = met.groupBy(F.greatest("a_root", "b_root").alias("root")).agg(F.min(F.least("a_root", "b_root")).alias("up"))
    return labels.join(settled(up), "root", "left").select("node", F.coalesce("up", "root").alias("root"))


def _unmet(members: DataFrame, labels: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Every pair (a, b) of texts of two components that share a band with another component and may be as similar as ``least``.

    A gram that only one component holds joins nothing. With such grams first and rare ones next, two sets of
    that similarity share a gram within their first ``size - least * size + 1``, and the places of the first shared one
    bound the overlap: both conditions leave out no true pair. A text with too few shared grams is out at once, which
    is how clouds of edited copies end. The component with most texts of a gram is not joined with itself.
    """
    known = members.join(labels, F.col("text_key") == F.col("node")).select("band", "text_key", F.col("root").alias("label"))
    two = (F.min("label") < F.max("label")).alias("two")
    apart = known.groupBy("band").agg(two).where("two")
    left = settled(known.join(apart, "band", "left_semi").select("text_key", "label").distinct())
    held = left.join(sets, "text_key").select("text_key", "label", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    shared = settled(held.groupBy("gram").agg(F.count(F.lit(1)).alias("holders"), two).where("two").select("gram", "holders"))
    own = Window.partitionBy("text_key")
    placed = held.join(shared, "gram").withColumn("useful", F.count(F.lit(1)).over(own))
    placed = placed.withColumn("place", F.col("size") - F.col("useful") + F.row_number().over(own.orderBy("holders", "gram")))
    places = placed.where(F.col("place") <= F.col("size") - _at_least(least * F.col("size")) + 1)
    places = settled(places.select("gram", "text_key", "label", "size", "place"))
    most = places.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("gram").agg(F.max(F.struct("n", "label")).alias("most"), two).where("two")
    most = settled(most.select("gram", F.col("most.label").alias("main")))
    one = places.join(most, "gram").where("label <> main").select("gram", "main", *[F.col(c).alias(f"one_{c}") for c in ("text_key", "label", "size", "place")])
    once = (F.col("label") == F.col("main")) | (F.col("one_text_key") < F.col("text_key"))
    overlap = 1 + F.least(F.col("size") - F.col("place"), F.col("one_size") - F.col("one_place"))
    enough = overlap >= _at_least(least / (1 + least) * (F.col("size") + F.col("one_size")))
    on = (places["gram"] == one["gram"]) & (F.col("label") != F.col("one_label")) & once & enough
    pairs = places.join(one, on).select(F.least("text_key", "one_text_key").alias("a"), F.greatest("text_key", "one_text_key").alias("b"))
    return settled(pairs.distinct())


def _at_least(number: Column) -> Column:
    """The smallest whole number that is not below, but for what floating point adds."""
    return F.ceil(number - 1e-9)


def near_copies(docs: DataFrame, linked: DataFrame | None = None, least: float = SIMILARITY, rounds: int = LEADERS) -> DataFrame:
    """doc_id, text_key and component_key of every row: texts joined by ``linked`` (pairs a, b of text keys, such as
    SimHash finds) or by a verified Jaccard similarity of ``least`` or more, over any number of links, share a component.

    In each round the texts of a band meet one leader, and only those not known to be in its component: first the text
    with the most neighbours in all its bands, then another one, drawn by a hash, each round. A sketch of the
    signatures is compared inside the join, so few unlike pairs leave it; the shingle sets decide. The work of a round is
    linear in the texts, however large a group is. What the rounds leave apart in a band then meets through its rarest
    shingles (``_unmet``), which loses no pair: no link between texts that share a band depends on who led it. Of two equally
    good leaders the greater key leads.

    NULL texts count as empty; a text longer than a task's memory is not supported.
    """
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    narrow, plain = rows.select("doc_id", "text_key"), rows.select("text_key", "text")
    texts = settled(_banded(plain))
    members = texts.select("text_key", F.explode("bands").alias("band")).distinct()
    crowds = members.groupBy("band").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    members = settled(members.join(crowds, "band"))
    degrees = members.groupBy("text_key").agg(F.sum("crowd").alias("degree"))
    about = settled(texts.select("text_key", "n", "low", "high").join(degrees, "text_key"))
    sets = _sets(plain, about.select("text_key"))
    links = plain.select(F.col("text_key").alias("a"), F.col("text_key").alias("b")).limit(0) if linked is None else linked.select("a", "b")
    links = settled(links)
    labels = settled(_hooked(about.select(F.col("text_key").alias("node"), F.col("text_key").alias("root")), links))
    for turn in range(rounds):
        known = about.join(labels, F.col("text_key") == F.col("node"))
        known = known.select("text_key", "n", "low", "high", "degree", F.col("root").alias("label"))
        here = members.select("band", "text_key").join(known, "text_key")
        rank = F.col("degree") if turn == 0 else F.xxhash64("text_key", "band", F.lit(turn))
        lead = F.max(F.struct(rank.alias("rank"), "text_key", "n", "low", "high", "label")).alias("lead")
        apart = here.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), lead).where("least <> most")
        apart = settled(apart.select("band", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("text_key", "n", "low", "high", "label")]))
        if apart.isEmpty():
            break
        sizes = (F.col("n") >= F.lit(least) * F.col("lead_n")) & (F.col("lead_n") >= F.lit(least) * F.col("n"))  # else never similar
        differ = F.bit_count(F.col("low").bitwiseXOR(F.col("lead_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("lead_high")))
        on = (here["band"] == apart["band"]) & (F.col("label") != F.col("lead_label")) & sizes & (differ <= sketch_limit(least))
        pairs = here.join(apart, on).select(F.least("text_key", "lead_text_key").alias("a"), F.greatest("text_key", "lead_text_key").alias("b"))
        found = _verified(settled(pairs.distinct()), sets, least)
        links = links.unionByName(found)
        labels = settled(_hooked(labels, found))
    else:
        links = links.unionByName(_verified(_unmet(members, labels, sets, least), sets, least))
    every = narrow.join(settled(components(links)), F.col("text_key") == F.col("node"), "left")
    return every.select("doc_id", "text_key", F.coalesce("root", "text_key").alias("component_key"))


def sketch_limit(least: float) -> int:
    """Bits of the sketch in which texts of that similarity differ at most, but for 4 standard deviations (1 in 20,000)."""
    share = (1 - least) / 2
    return int(PERMUTATIONS * share + 4 * (PERMUTATIONS * share * (1 - share)) ** 0.5)


def similar(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id linked to it over any number of links) and n_links (other texts it links to).

    Texts that agree in a whole band of their signatures meet in a join; the Jaccard similarity of their true shingle
    sets decides. Copies meet once, through the hash of their text, and are not expanded. Every link between different
    texts that a band proposes is verified and counted, so the work grows with the number of true links: for classes of
    very many different texts use the SimHash operator, whose fingerprints collapse first.
    """
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_text_key"), text.alias("text"))
    narrow = settled(rows.select("doc_id", "_text_key"))
    plain = rows.select(F.col("_text_key").alias("text_key"), "text")
    bands = settled(_banded(plain).select("text_key", F.explode("bands").alias("band")).distinct())
    other = bands.select("band", F.col("text_key").alias("other_key"))
    pairs = settled(bands.join(other, "band").where("text_key < other_key").select("text_key", "other_key").distinct())
    asked = pairs.select(F.explode(F.array("text_key", "other_key")).alias("text_key")).distinct()
    links = _verified(pairs.toDF("a", "b"), _sets(plain, asked), least)
    counts = links.select(F.explode(F.array("a", "b")).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(links)
    known = counts.join(roots, F.col("_key") == F.col("node")).select("_key", "n_links", "root")
    joined = narrow.join(settled(known), F.col("_text_key") == F.col("_key"), "left")
    joined = joined.select("doc_id", F.coalesce("root", "_text_key").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    joined = settled(joined)
    classes = settled(joined.groupBy("root").agg(F.min("doc_id").alias("class_id")))
    return joined.join(classes, "root").select("doc_id", "class_id", "n_links")
