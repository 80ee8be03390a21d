"""Runs against a search of every period, Lyndon arrays against a comparison of suffixes."""

import random
import re
import zlib

import numpy as np
import pytest
from llm_data import docs, prose, rows, with_clashes

from evidrank.llm import blocks, queries, runs


def brute_runs(x, least=6, exponent=4):
    found = []
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, exponent * q, 2 * q):
                if not any(all(x[k] == x[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                    found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic(seed):
    pick = random.Random(seed)
    n, k = pick.randint(0, 60), pick.randint(1, 4)
    x = [pick.randrange(k) for _ in range(n)]
    if n and pick.random() < 0.6:
        a = pick.randrange(n)
        p = 1 + (n - a) // (3 + pick.randrange(8))
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    return x


def test_lyndon_arrays():
    for seed in range(400):
        x = blocks.numbered(np.array(periodic(seed), np.int64)).tolist()
        if x:
            ends = [next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x)) for i in range(len(x))]
            assert runs.lyndon_lengths(x, max(x) + 1) == [e - i for i, e in enumerate(ends)]


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (6, 3), (10, 2)])
def test_runs_of_sequences(least, exponent):
    texts = [[b"%d" % v for v in periodic(seed)] for seed in range(500)]
    assert runs.document_runs(texts, least, exponent) == [brute_runs(t, least, exponent) for t in texts]


def test_long_runs_and_nested_periods():
    x = ([0] * 30 + [1]) * 40 + list(range(2, 500)) + [7, 8, 9] * 3000
    found = runs.document_runs([[b"%d" % v for v in x]])[0]
    assert (0, 31 * 40, 31) in found and found[-1][1:] == (9000, 3) and (0, 30, 1) in found


def planted(made):
    out = []
    for doc_id, text, *_ in made:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if doc_id is not None and words:
            h = zlib.crc32(str(doc_id).encode())
            if h % 10 == 0:
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute_runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        out.append((doc_id, found, " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    made = [r for r in rows() if r[0] != 7] + [(k, prose(k, 40 + k), "en", "a", 1) for k in range(200, 290)]
    made += [(300, "a b " * 40 + "c", "en", "a", 1), (301, "x " * 7, "en", "a", 1), (302, "x " * 5, "en", "a", 1)]
    frame = queries.with_planted_runs(with_clashes(docs(spark, made)))
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(frame).collect()]
    want = planted(made)
    assert sorted(got, key=str) == want
    assert sum(bool(r[1]) for r in want) > 10


def test_empty_table_long_text_and_options(spark):
    assert runs.find_runs(docs(spark, [])).count() == 0
    (row,) = runs.find_runs(docs(spark, [(1, "tick tock " * 50_000, "en", "a", 1)])).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 100_000, 2)] and row["collapsed"] == "tick tock"
    with pytest.raises(ValueError):
        runs.find_runs(docs(spark, []), exponent=1)
