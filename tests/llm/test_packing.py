import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_data import docs, plain, rows, with_clashes
from tokenizers import Tokenizer

from evidrank.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PARAMS = packing.Packing(tokenizer=PATH)


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, texts, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    want = defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append(ids_of(text))
    assert set(by_doc) == set(want)
    for doc_id, lists in want.items():
        got = sorted(by_doc[doc_id], key=lambda p: p.start)
        assert sum(p.length for p in got) == sum(map(len, lists))
        if len(lists) == 1:
            at = 0
            for p in got:
                assert p.start == at and p.doc_tokens == len(lists[0])
                assert bytes(p.ids) == np.array(lists[0][at : at + p.length], "<u4").tobytes()
                at += p.length
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        assert {p.padded for p in own} == {at if at & (at - 1) == 0 else size}
        padding += own[0].padded - at
    return padding


def test_every_id_lies_in_one_piece(spark):
    pieces = packing.pack(docs(spark).coalesce(2), PARAMS).collect()
    assert check(pieces, [(r[0], r[1]) for r in rows()], 2048) < 300


def test_small_blocks_and_sequences(spark):
    p = packing.Packing(tokenizer=PATH, size=64, block=256, stretch=16)
    check(packing.pack(docs(spark), p).collect(), [(r[0], r[1]) for r in rows()], 64)


def test_clashing_columns_and_empty_table(spark):
    plain_rows = plain(packing.pack(docs(spark).coalesce(1), PARAMS))
    assert plain(packing.pack(with_clashes(docs(spark).coalesce(1)), PARAMS)) == plain_rows
    assert packing.pack(docs(spark, []), PARAMS).count() == 0


@pytest.mark.parametrize("text", ["Don't stop; it's 12 o'clock!", "ǅ J̌ΣΑΣ İ", "a b c\x1cd\x85e", "<|endoftext|> x", "é́ ﬁ ½"])
def test_chunks_give_the_tokenizers_ids(text):
    assert packing.encoder(PATH).encode(text) == np.array(ids_of(text)[:-1], "<u4").tobytes()


def test_cuts_are_optimal():
    p = packing.Packing(tokenizer=PATH, size=16, window=1.0)
    rng = np.random.default_rng(3)
    for last in (True, False):
        for _ in range(20):
            at = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 9, 12))]))
            price = rng.integers(0, 6, len(at)).astype(float)
            cuts = packing.choose_cuts(at, price, p, last)

            def cost(chosen):
                total = 0
                for a, b in zip(chosen, chosen[1:]):
                    n = b - a
                    whole = n & (n - 1) == 0 and (last or n >= 64 or n == p.size)
                    total += (0 if whole else p.size - n) + price[list(at).index(b)] + p.window
                return total

            best = {0: (0, [0])}
            for j in at[1:]:
                ways = [(cost([*c[1], j]), [*c[1], j]) for i, c in best.items() if j - i <= p.size]
                best[int(j)] = min(ways, key=lambda w: w[0])
            assert cost(cuts) == best[cuts[-1]][0]
            assert not last or cuts[-1] == at[-1]


def test_digest_of_the_query(spark):
    from pyspark.sql import functions as F

    for r in packing.pack(docs(spark), PARAMS).select("ids", F.crc32("ids").alias("c")).collect():
        assert r.c == zlib.crc32(bytes(r.ids))


def test_a_worker_remembers_a_bounded_amount(monkeypatch):
    words = packing._Encoder(PATH)
    monkeypatch.setattr(words, "_word", lambda word: b"12345678")
    letters = "abcdefghijklmnopqrstuvwxyz"
    for a in letters:
        for b in letters[:16]:
            words.encode(" ".join(f"{a}{b}{c}{d}e{e}" for c in letters for d in letters for e in letters[:4]))
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) for m in (words, words.older) for k, v in m.items())
    assert held + sys.getsizeof(words) + sys.getsizeof(words.older) < 60e6


@pytest.mark.parametrize("text", ["", "... ", "aneser Aneser, ANESER! aneser... ,aneser", "Ⱥ ⱥ Ⱥ, ŉ ʼN ǅ. ǆ ǅ ẞ ß, ö Ö Ö! ö"])
def test_words_remembered_in_another_form(text):
    want = np.array(ids_of(text)[:-1], "<u4").tobytes()
    assert packing._Encoder(PATH).encode(text) == want
    words = packing._Encoder(PATH)
    chunks = [c for _ in range(2) for c in text.split()[::-1]]
    assert words.encode(" ".join(chunks)) == np.array(ids_of(" ".join(chunks))[:-1], "<u4").tobytes()
    assert words.encode(text) == want
