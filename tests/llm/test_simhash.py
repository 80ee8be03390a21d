import random

import numpy as np
import xxhash
from llm_data import docs, plain, rows, with_clashes

from evidrank.llm import simhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, distance=4):
    """prints: {node: bits}; the smallest node reachable."""
    nodes = sorted(prints)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    assert len(got) == len(rows())
    texts = {r[0]: r[1] for r in rows() if r[0] is not None}
    prints = {i: brute_print(t) for i, t in texts.items()}
    want = brute_components(prints)
    for r in got:
        if r.doc_id is not None:
            assert r.bits % (1 << 64) == prints[r.doc_id]
            assert r.component_id == want[r.doc_id]
        else:
            assert r.bits % (1 << 64) == brute_print(next(t for i, t, *_ in rows() if i is None))
    assert want[4] == want[5] == want[6] == 4 and want[2] == 1


def links_by_brute_force(values, distance):
    return {(a, b) for a in values for b in values if a < b and bin((a ^ b) % (1 << 64)).count("1") <= distance}


def clustered(seed, n, centres):
    pick = random.Random(seed)
    bases = [pick.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        v = pick.choice(bases)
        for b in pick.sample(range(64), pick.randrange(0, 7)):
            v ^= 1 << b
        out.add(v - (1 << 64) if v >> 63 else v)
    return sorted(out)


def test_links_lose_no_pair(spark):
    values = clustered(1, 400, 12)
    prints = spark.createDataFrame([(v,) for v in values], "bits long")
    got = simhash.links(prints).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == links_by_brute_force(values, 4)


def test_every_plan_is_whole(spark):
    """Thresholds of any plan that the programme can choose find the same links."""
    values = clustered(2, 60, 3)
    want = links_by_brute_force(values, 4)
    both = np.zeros((64, 64))
    for v in values:
        bits = np.array([(v >> b) & 1 for b in range(64)], float)
        both += np.outer(bits, bits)
    for n in (len(values), 10**5, 10**9):
        plan = simhash.plan_parts(n, both * (n / len(values)), 4)
        assert sum(t + 1 for _, t in plan) == 5
        found = set()
        for bits, t in plan:
            mask = sum(1 << b for b in bits)
            found |= {(a, b) for a in values for b in values if a < b and bin((a ^ b) & mask).count("1") <= t}
        assert want <= found


def test_allotment_is_the_cheapest():
    from itertools import product

    pick = random.Random(5)
    for _ in range(30):
        costs = [[0.0, *sorted(pick.random() * 10 for _ in range(5))] for _ in range(3)]
        cost, chosen = simhash.allot(costs, 5)
        ways = [t for t in product(range(-1, 5), repeat=3) if sum(x + 1 for x in t) == 5]
        assert abs(cost - min(sum(c[x + 1] for c, x in zip(costs, t)) for t in ways)) < 1e-9
        assert sum(x + 1 for x in chosen) == 5


def test_components_of_chains_stars_and_cliques(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 140)]
    clique = [(a, b) for a in range(200, 215) for b in range(a + 1, 215)]
    mixed = [(5000, 7000), (6000, 7000), (6000, 8000), (5500, 8000)]
    got = simhash.components(spark.createDataFrame(chain + star + clique + mixed, "a long, b long")).collect()
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {k: 200 for k in range(200, 215)}
    want |= {k: 5000 for k in (5000, 5500, 6000, 7000, 8000)}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_one_of_each_component_is_kept(spark):
    kept = simhash.keep_first(with_clashes(docs(spark)))
    assert kept.columns == with_clashes(docs(spark)).columns
    ids = [r.doc_id for r in kept.collect()]
    texts = {r[0]: r[1] for r in rows() if r[0] is not None}
    roots = set(brute_components({i: brute_print(t) for i, t in texts.items()}).values())
    assert sorted(i for i in ids if i is not None) == sorted(roots) and ids.count(None) == 1


def test_clashing_columns_and_empty_table(spark):
    assert plain(simhash.near_duplicates(with_clashes(docs(spark)))) == plain(simhash.near_duplicates(docs(spark)))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.keep_first(docs(spark, [])).count() == 0
