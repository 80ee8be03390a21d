"""Source divergence against dictionaries, for cubes of one cell and of many."""

import re
from collections import Counter, defaultdict

import pytest
from llm_data import docs, rows, with_clashes

from evidrank.llm import divergence


def brute(made, least, top=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in made:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang in held:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        groups = {s: c for (g, s), c in counts.items() if g == lang}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        whole = shares(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(whole[t] - p[s][t], t) for t in kept if groups[s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda r: (r[0], r[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def table():
    made = rows() + [(500, "Ünder été Z" * 3, None, None, 1), (501, None, "xx", "a", 1), (502, "", "xx", "b", 1), (503, "one", "yy", "", 1)]
    return made + [(600 + k, f"alpha{'bcd'[k % 3]} beta mu {'nu ' * (k % 5)}", "en", f"s{k % 11}", 1) for k in range(80)]


@pytest.mark.parametrize("sources, terms", [(32, 4096), (2, 5), (1, 1)])
def test_agrees_with_brute_force(spark, sources, terms):
    made = table()
    got = divergence.audit(with_clashes(docs(spark, made)).repartition(3), least=4, sources=sources, terms=terms)
    assert sorted(map(tuple, got.collect())) == brute(made, 4)


def test_many_partial_counts_and_few_ranks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_FULL", 3)
    made = table()
    got = divergence.audit(docs(spark, made), least=1, top=2)
    assert sorted(map(tuple, got.collect())) == brute(made, 1, 2)


def test_no_kept_terms_and_empty_table(spark):
    made = [(1, "a b", "en", "x", 1), (2, "c", "en", "y", 1), (3, "d", "en", None, 1)]
    got = sorted(map(tuple, divergence.audit(docs(spark, made)).collect()))
    assert got == brute(made, 30) and {r[4] for r in got} == {0} and len(got) == 6
    assert divergence.audit(docs(spark, [])).count() == 0
