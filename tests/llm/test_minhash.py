import hashlib
import random

import pytest
from llm_data import docs, plain, prose, rows, with_clashes

from evidrank.llm import minhash


def by_hand(made):
    """Rows in order of id (NULL first) and text, each with the next one's text."""
    order = sorted(((i, t or "") for i, t, *_ in made), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        a, b, c = (minhash.signature(t) for t in (text, edited, following))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), minhash.written(a), minhash.written(b), minhash.likeness(a, b), minhash.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("made", [rows(), rows()[:1], rows()[:4], []])
def test_each_document_meets_the_next(spark, made):
    assert plain(minhash.compare_with_next(docs(spark, made).repartition(5))) == by_hand(made)


def test_many_rows_over_many_ranges(spark):
    made = [(k * 37 % 5003, prose(k, 3 + k % 30), "en", "a", 0) for k in range(1500)]
    assert plain(minhash.compare_with_next(docs(spark, made).repartition(6))) == by_hand(made)


def test_clashing_columns(spark):
    assert plain(minhash.compare_with_next(with_clashes(docs(spark)))) == plain(minhash.compare_with_next(docs(spark)))


def test_likeness_estimates_jaccard():
    pick = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    for share in (0.1, 0.3, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(15):
            common = pick.sample(words, 1000)
            a = " ".join(common)
            cut = int(1000 * (1 - share))
            b = " ".join([*pick.sample(words, cut), *common[cut:]])
            s = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
            true = len(s(a) & s(b)) / len(s(a) | s(b))
            errors.append(minhash.likeness(minhash.signature(a), minhash.signature(b)) - true)
        assert abs(sum(errors) / len(errors)) < 0.04 and max(map(abs, errors)) < 0.2


def test_shared_beginnings_change_nothing():
    a = prose(1, 300)
    for b in (prose(2, 300), a[:500] + " other end", a, "", "one two", a[:-3]):
        x, y = minhash.both_signatures(a, b)
        assert (x == minhash.signature(a)).all() and (y == minhash.signature(b)).all()


def test_letters_and_spaces():
    assert (minhash.signature("A b C d E f") == minhash.signature("a  B\tc D\ne F")).all()
    assert not (minhash.signature("Ä b c d e f") == minhash.signature("ä b c d e f")).all()
    assert minhash.likeness(minhash.signature(""), minhash.signature(" \n")) == 1.0
    assert minhash.likeness(minhash.signature(""), minhash.signature("a")) < 0.1


def brute_classes(texts, least=0.8):
    """{representative: ids} of {id: text} by the true Jaccard similarity of all pairs of texts, over any number of links."""
    ids = {}
    for i, t in texts.items():
        ids.setdefault(t or "", []).append(i)
    keys = sorted(ids)
    sets = [frozenset(minhash.shingles(minhash.word_hashes(t)).tolist()) for t in keys]
    root = list(range(len(keys)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for n, a in enumerate(sets):
        for m, b in enumerate(sets[:n]):
            if len(a & b) >= least * len(a | b):
                root[find(n)] = find(m)
    classes = {}
    for n, t in enumerate(keys):
        classes.setdefault(find(n), []).extend(ids[t])
    return classes


def edited(seed, words, n, fresh):
    pick = random.Random(seed)
    out = list(words)
    for k in range(n):
        out[pick.randrange(len(out))] = f"{fresh}{k}"
    return " ".join(out)


def test_near_copies_against_every_pair(spark):
    """A hot group of near copies, groups of other sizes, copies, NULLs, empty and short texts, repeated rows, clashing columns."""
    made = [r for r in rows() if r[0] is not None]
    hot = prose("hot", 160).split()
    made += [(1000 + k, edited(k, hot, 1 + k % 4, f"e{k}x"), "en", "a", 0) for k in range(150)]
    made += [(2000 + k, edited(k, prose(f"g{k % 15}", 120).split(), k % 5, f"f{k}x"), "en", "a", 0) for k in range(90)]
    made += [(3000 + k, edited(k, prose("cloud", 100).split(), 18, f"c{k}x"), "en", "a", 0) for k in range(60)]
    texts = {i: t for i, t, *_ in made}
    want = sorted(sorted(set(ids)) for ids in brute_classes(texts).values())
    for linked in (None, spark.createDataFrame([], "a long, b long")):
        classes = {}
        for i, _, c in map(tuple, minhash.near_copies(with_clashes(docs(spark, made)), linked).collect()):
            classes.setdefault(c, set()).add(i)
        assert sorted(map(sorted, classes.values())) == want
    assert max(map(len, want)) > 100
    assert minhash.near_copies(docs(spark, [])).count() == 0


@pytest.mark.parametrize("m, n, changed, rounds", [(240, 200, 3, minhash.LEADERS), (120, 200, 3, 1), (120, 200, 3, 0)])
def test_large_bands_lose_no_link(spark, m, n, changed, rounds):
    """A cloud in which few pairs reach the similarity, so that most leaders of a band meet none of its links."""
    pick = random.Random(1)
    base = pick.choices([f"w{k}" for k in range(400)], k=n)
    made = [(k, edited(f"1/{k}", base, changed, f"c{k}x"), "en", "a", 0) for k in range(m)]
    want = sorted(sorted(set(ids)) for ids in brute_classes({i: t for i, t, *_ in made}).values())
    classes = {}
    for i, _, c in map(tuple, minhash.near_copies(docs(spark, made), rounds=rounds).collect()):
        classes.setdefault(c, set()).add(i)
    assert sorted(map(sorted, classes.values())) == want


def test_given_links_join_components(spark):
    made = [(k, prose(f"l{k}", 30), "en", "a", 0) for k in range(6)]
    keys = {r.doc_id: r.text_key for r in minhash.near_copies(docs(spark, made)).collect()}
    linked = spark.createDataFrame([tuple(sorted((keys[0], keys[3]))), tuple(sorted((keys[3], keys[5])))], "a long, b long")
    found = {r.doc_id: r.component_key for r in minhash.near_copies(docs(spark, made), linked).collect()}
    assert len(set(found.values())) == 4 and found[0] == found[3] == found[5]


def test_similar_texts_against_every_pair(spark):
    pick = random.Random(11)
    made = list(rows())
    for k in range(40):
        words = prose(f"c{k % 6}", 150).split()
        for _ in range(pick.randrange(0, 8)):
            words[pick.randrange(len(words))] = pick.choice(["omega", "psi", "chi"])
        made.append((500 + k, " ".join(words), "en", "a", 0))
    texts = {}
    for i, t, *_ in made:
        texts.setdefault(t or "", []).append(i)
    keys = sorted(texts)
    sets = {t: frozenset(minhash.shingles(minhash.word_hashes(t)).tolist()) for t in keys}
    links, root = {t: 0 for t in keys}, {t: t for t in keys}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for n, a in enumerate(keys):
        for b in keys[:n]:
            if (sets[a] or sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or not (sets[a] or sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    classes = {}
    for t in keys:
        classes.setdefault(find(t), []).extend(i for i in texts[t] if i is not None)
    want = sorted(((i, min(classes[find(t)], default=None), links[t]) for t in keys for i in texts[t]), key=str)
    assert max(links.values()) >= 3
    assert plain(minhash.similar(with_clashes(docs(spark, made)))) == want
    assert minhash.similar(docs(spark, [])).count() == 0
