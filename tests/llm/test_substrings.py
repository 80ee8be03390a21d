"""Substring dedup against a brute-force count of all windows."""

import random
import re

import pytest
from llm_data import docs, prose, rows, with_clashes

from evidrank.llm import substrings


def brute(made, width):
    """{row: (n_words, kept words)} by the rule itself."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in made]
    first = {}
    for r, w in zip(made, words):
        for i in range(len(w) - width + 1):
            if r[0] is not None:
                key = tuple(w[i : i + width])
                first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r, w in zip(made, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if r[0] is not None and first[tuple(w[i : i + width])] < r[0]:
                gone.update(range(i, i + width))
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def got(spark, df, **options):
    return sorted(map(tuple, substrings.dedup(df, **options).collect()), key=str)


def passages(seed, n, words="a b c d e f".split()):
    """Texts built of shared passages, own words and repeated lines."""
    pick = random.Random(seed)
    shared = [" ".join(pick.choices(words, k=pick.choice([3, 9, 14, 40]))) for _ in range(5)]
    made = []
    for k in range(n):
        parts = [pick.choice([pick.choice(shared), prose(f"{seed}-{k}-{i}", pick.choice([2, 20])), "x " * pick.choice([5, 30])]) for i in range(5)]
        made.append((pick.choice([k, k, k // 2]), " ".join(parts), "en", "s", 1))
    return made


@pytest.mark.parametrize("crowd", [1000, 0, 3])
@pytest.mark.parametrize("width, part", [(8, 3), (8, 8), (5, 1)])
def test_agrees_with_brute_force_in_plain_and_crowded_buckets(spark, width, part, crowd):
    made = passages(f"{width}", 40)
    assert got(spark, docs(spark, made).repartition(5), width=width, part=part, crowd=crowd) == brute(made, width)


def test_awkward_rows_and_clashing_columns(spark):
    made = rows()
    want = brute(made, 50)
    assert got(spark, with_clashes(docs(spark, made))) == want
    assert any(r[2] for r in want), "the copies of the base text go"
    assert got(spark, docs(spark, [])) == []


def test_rows_of_one_id_and_null_ids_leave_each_other_alone(spark):
    text = prose("same", 70)
    made = [(None, text, "en", "a", 1), (5, text, "en", "a", 1), (5, text + " more", "en", "a", 1), (9, text, "en", "a", 1), (None, text, "en", "a", 1)]
    assert got(spark, docs(spark, made)) == brute(made, 50)
    assert {(r[0], r[2]) for r in brute(made, 50)} == {(None, 0), (5, 0), (9, 70)}


def test_a_large_group_of_near_copies(spark):
    base = prose("hot", 200).split()
    made = [(k, " ".join(base[: 7 * (k % 25)] + [f"w{k}"] + base[7 * (k % 25) :]), "en", "a", 1) for k in range(300)]
    for crowd in (1000, 20):
        assert got(spark, docs(spark, made), crowd=crowd) == brute(made, 50)


def test_long_super_kmers_are_cut(spark):
    made = [(1, "z " * 3000, "en", "a", 1), (2, "y " + "z " * 1500, "en", "a", 1), (3, "z " * 49, "en", "a", 1)]
    assert got(spark, docs(spark, made)) == brute(made, 50)
    _, long, _ = substrings.super_kmers((b"z " * 3000).split())
    assert long.max() <= 512 and long.sum() == 2951
