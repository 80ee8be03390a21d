from collections import Counter, defaultdict

import pytest
from llm_data import docs, plain, prose, rows, with_clashes

from evidrank.llm import mixing


def by_hand(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing the excess round after round; sizes by source, NULL as None."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    target, full = {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / rest for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def corpus(spark):
    made = [(k, prose(k, 5 + k % 60), "en", "ab" if k % 3 == 0 else f"s{k % 7}", k) for k in range(400)]
    made += [(1000 + k, prose(k, 30), "en", None, 1) for k in range(30)] + [(2000, None, "en", "é", 0), (2001, " ", "en", "zz", 0)]
    return docs(spark, made), made


def test_targets_and_copies(spark):
    table, made = corpus(spark)
    sizes, texts = defaultdict(int), {}
    for i, text, _, source, _ in made:
        n = len((text or "").split())
        sizes[source] += n
        texts[i] = (n, source)
    target = by_hand(sizes)
    taken = Counter()
    for r in mixing.mix_sizes(table).collect():
        n, source = texts[r.doc_id]
        assert (r.size, r.source, r.source_size) == (n, source, sizes[source])
        assert r.target == pytest.approx(target[source])
        rate = target[source] / sizes[source] if sizes[source] else 0
        assert r.copies in (int(rate), int(rate) + (rate > int(rate))) and r.taken == r.size * r.copies <= 2 * r.size
        taken[source] += r.taken
    for source, want in target.items():
        assert taken[source] == pytest.approx(want, rel=0.05, abs=1)


def test_rows_of_the_mix_are_the_copies(spark):
    table = with_clashes(docs(spark))
    sizes = Counter()
    for r in mixing.mix_sizes(table).collect():
        sizes[r.doc_id] += r.copies
    mix = mixing.copies(table)
    assert mix.columns == table.columns
    assert Counter(r.doc_id for r in mix.collect()) == +sizes


def test_reruns_agree_whatever_the_partitions(spark):
    table = docs(spark)
    assert plain(mixing.mix_sizes(table)) == plain(mixing.mix_sizes(table.repartition(7)))


def test_repeats_and_empty_tables(spark):
    got = [r.copies for r in mixing.mix_sizes(docs(spark)).collect() if r.doc_id == 2]
    assert len(got) == 2 and len(set(got)) == 1
    assert len(rows()) == mixing.mix_sizes(docs(spark)).count()
    assert mixing.mix_sizes(docs(spark, [])).count() == 0 and mixing.copies(docs(spark, [])).count() == 0
    blank = docs(spark, [(1, None, "en", "a", 0), (2, "", "en", "b", 0)])
    assert [(r.target, r.taken) for r in mixing.mix_sizes(blank).collect()] == [(0.0, 0)] * 2
