import math
import re
from collections import Counter

import pytest
from llm_data import docs, plain, rows, with_clashes

from evidrank.llm import lm
from evidrank.llm.common import settled

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(made, factor=0.4, least=2):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))) for i, t, *_ in made]
    counts = Counter(tuple(w[k : k + n]) for _, w in split for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total = sum(len(w) for _, w in split)
    out = []
    for i, words in split:
        used, logs = Counter(), 0.0
        for k in range(len(words)):
            for n in range(min(3, k + 1), 0, -1):
                gram = tuple(words[k - n + 1 : k + 1])
                if n == 1 or counts[gram] >= least:
                    logs += math.log(counts[gram] / (counts[gram[:-1]] if n > 1 else total))
                    used[n] += 1
                    break
                logs += math.log(factor)
        out.append((i, len(words), used[3], used[2], used[1], logs, logs / len(words) if words else None))
    return sorted(out, key=lambda r: str(r[:2]))


@pytest.mark.parametrize("p", [lm.Backoff(), lm.Backoff(block=300, partition_chars=2000), lm.Backoff(factor=0.2, least=4)])
def test_scores_by_hand(spark, p):
    table = settled(docs(spark).repartition(3))
    got = sorted(map(tuple, lm.score(table, p).collect()), key=lambda r: str(r[:2]))
    want = by_hand(rows(), p.factor, p.least)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-9)


def test_clashing_columns_and_empty_tables(spark):
    table = settled(docs(spark).repartition(2))
    assert plain(lm.score(with_clashes(table)).select("doc_id", "n_words")) == plain(lm.score(table).select("doc_id", "n_words"))
    assert lm.score(docs(spark, [])).count() == 0
    assert plain(lm.score(settled(docs(spark, [(1, None, "", "", 0), (2, " ", "", "", 0)])))) == [(1, 0, 0, 0, 0, 0.0, None), (2, 0, 0, 0, 0, 0.0, None)]
