"""Pieces of words that were not seen before."""

import random
import time

from cinequery.llm import queries, sentencepiece

ODD = ["日本語", "é" * 5, "\U0001f600", "\U0001f600a\U0001f600", "x\x00y", "ÿ", "the" * 21, "the" * 22, "日" * 70, "a" * 300, "q" * 62, "q" * 63, "q" * 64]


def words(rng, n):
    parts = ["an", "the", "ion", "st", "er", "wh", "ble", "ou", "k", "é", "語"]
    return ["".join(rng.choices(parts, k=rng.randint(2, 6))) + str(k) for k in range(n)]


def test_new_words_cost_less_than_one_lattice_each():
    t, rng = sentencepiece.load(queries.MODEL_PATH), random.Random(3)
    together, apart = [], []
    for _ in range(3):
        some = words(rng, 8000)
        began = time.process_time()
        got = t.encode(" ".join(some)).tolist()
        middle = time.process_time()
        want = [i for w in some for i in t.viterbi(sentencepiece.MARK + w)]
        together.append(middle - began)
        apart.append(time.process_time() - middle)
        assert got == want
    assert min(together) < min(apart) / 2


def test_odd_words_have_the_pieces_of_their_own_lattice(monkeypatch):
    t, rng = sentencepiece.load(queries.MODEL_PATH), random.Random(4)
    monkeypatch.setattr(sentencepiece, "CACHE", 50)
    for size in (1, 7, 400):
        some = rng.sample(ODD * 40 + words(rng, 400), size)
        for seen in range(2):
            assert t.encode(" ".join(some)).tolist() == [i for w in some for i in t.viterbi(sentencepiece.MARK + w)]
    texts = [None, "", " ", "▁", "▁▁ ▁a", " " * 100, *ODD, "\n\t a "]
    assert [t.decode(ids.tolist()) for ids in t.encode_all(texts)] == [x or "" for x in texts]
