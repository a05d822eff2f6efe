"""What the driver's Python holds while a model is fitted."""

import tracemalloc

import numpy as np

from cinequery.llm import toxicity


def texts(n, words, sentence):
    """Rows (text, label), made one at a time; toxic documents have one word of their own."""
    rng = np.random.default_rng(5)
    for k in range(n):
        found = [f"w{x}" for x in rng.integers(0, 3000, words)]
        found[words // 2 : words // 2 + k % 2] = ["vile"] * (k % 2)
        yield ". ".join(" ".join(found[i : i + sentence]) for i in range(0, words, sentence)), k % 2


def test_fit_holds_neither_texts_nor_long_arrays_of_floats():
    n, words = 300, 3000
    tracemalloc.start()
    model = toxicity.fit(texts(n, words, 20), steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights["vile"] > max(w for k, w in model.weights.items() if k[0] == "w")
    assert peak < 24 * n * words  # bytes an entry; one array of floats takes 8


def test_blocks_change_no_sum(monkeypatch):
    rows = list(texts(40, 200, 20))
    whole = toxicity.fit(rows, steps=50)
    monkeypatch.setattr(toxicity._blocks, "__defaults__", (64,))
    parts = toxicity.fit(iter(rows), steps=50)
    assert whole.weights.keys() == parts.weights.keys()
    assert all(np.isclose(w, parts.weights[k], rtol=0, atol=1e-9) for k, w in whole.weights.items())
