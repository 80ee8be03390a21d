import re

from llm_data import docs, plain, prose, rows, with_clashes

from evidrank.llm import licenses

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
GPL = licenses.NOTICES["gpl-3"][0]
MIT = licenses.NOTICES["mit"][0]
TEXTS = [
    "Released under the MIT License. under THE mit-license; under the mitt license",
    "Licensed under the Apache License, Version 2.0. apache license version 2 apache license version 3",
    "CC BY-NC 4.0 cc by nc cc by nc by nc",
    prose(1, 50) + " " + GPL + " " + prose(2, 30),
    prose(3, 20) + " " + MIT.replace("documentation files", "docs").replace("restriction", "any restriction") + " " + prose(4, 20),
    MIT[:60],
    "ünder the mit license under the mit lizenzé cc by nc",
    ("under the mit license " * 300) + prose(5, 400),
    "the the the the the the the mit",
]


def by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    hits = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits += [(a, label) for a in range(len(words) - len(p) + 1) if words[a : a + len(p)] == p]
    at = [a for a, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in hits}))


def test_base_places(spark):
    made = [(1000 + k, t, "en", "a", 0) for k, t in enumerate(TEXTS)] + rows()
    got = licenses.scan(with_clashes(docs(spark, made))).collect()
    assert len(got) == len(made)
    want = sorted(((i, *by_hand(t)) for i, t, *_ in made), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)


def test_notices_whole_edited_and_cut(spark):
    made = [(k, t, "en", "a", 0) for k, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, made)).collect()}
    assert got[3].labels == "gpl-3" and got[3].score == 1.0 and got[3].n_spans == 1
    assert got[4].labels == "mit" and 0.8 <= got[4].score < 1 and got[4].n_spans == 1
    assert got[5].labels == "" and 0 < got[5].score < 0.5
    assert got[8].labels == ""


def test_only_built_in_functions(spark):
    plan = licenses.scan(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("PythonRDD", "")) and "CartesianProduct" not in plan


def test_repeats_and_empty_table(spark):
    twice = docs(spark, [(1, TEXTS[0], "en", "a", 0)] * 2)
    assert len(plain(licenses.scan(twice))) == 2 and len(set(plain(licenses.scan(twice)))) == 1
    assert licenses.scan(docs(spark, [])).count() == 0
