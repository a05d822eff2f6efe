"""Near copies against brute force over all pairs; nulls, ties, repeats, empty tables, clashing columns."""

import random

import numpy as np

from cinequery.llm import near_copies

SCHEMA = "doc_id long, text string, id string, FP int, TEXT2 string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in texts], SCHEMA)


def brute(texts):
    sets = [set(near_copies.shingle_set(t, 5).tolist()) for _, t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (texts[a][1] or "") == (texts[b][1] or "") or sets[a] | sets[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return {d: min(texts[k][0] for k in range(len(texts)) if group[k] == group[n]) for n, (d, _) in enumerate(texts)}


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"e{rng.random()}"
    return " ".join(out)


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for copies in (40, 12, 3, 2, 1, 1, 1):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(words)] + [edited(rng, words, rng.choice((1, 2, 3, 14))) for _ in range(copies)]
    texts += [texts[0], texts[0], "", None, " ", "a b", "a b", "a c"]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(rows(spark, texts)).collect()}
    assert got == brute(texts)


def test_crowded_shingles_equal_brute_force(spark):
    rng = random.Random(7)
    base = [f"b{n}" for n in range(160)]
    texts = []
    for n in range(260):  # loose copies of one text: all share shingles, few pairs are similar
        words = edited(rng, base, rng.choice((1, 2, 2, 3, 3, 3))).split()
        texts.append((n, " ".join(words if n % 2 else words + [f"t{n // 4}_{k}" for k in range(30)])))
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(rows(spark, texts)).collect()}
    assert got == brute(texts) and 5 < len(set(got.values())) < 250


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(-(2**63), 2**63 - 1, rng.integers(0, 900))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(-(2**63), 2**63 - 1, rng.integers(0, 900))]))
        a = np.unique(a)
        x, y = near_copies.sketch(a), near_copies.sketch(b)
        assert near_copies.sketch_distance(x, y) <= len(np.setxor1d(a, b))
        assert near_copies.sketch_distance(x, x) == 0
        assert np.isclose(near_copies.jaccard(a, b), len(np.intersect1d(a, b)) / max(len(np.union1d(a, b)), 1))


def test_appended_and_replaced_passages_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    line = " ".join(word() for _ in range(12))  # stands in every text
    texts = []
    for n in range(240):
        words = [word() for _ in range(rng.choice((60, 120, 250)))]
        more = round(len(words) * rng.uniform(0.08, 0.26))
        at = rng.randrange(len(words) - more)
        if n % 3 == 0:
            copy = words + [word() for _ in range(more)]
        elif n % 3 == 1:
            copy = words[:at] + [word() for _ in range(more // 2)] + words[at + more // 2 :]
        else:
            copy = words[:at] + words[at + more :]
        texts += [f"{' '.join(words)} {line}", f"{' '.join(copy)} {line}"]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    want = brute(texts)
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(rows(spark, texts)).collect()}
    assert 80 < sum(want[d] != d for d in want) < 230
    assert (sum(got[d] != d for d in got), got) == (sum(want[d] != d for d in want), want)


def test_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "one two"), (None, "alone here"), (5, "w " * 30000), (6, "w " * 30001)]
    got = {(r.doc_id, r.component_id) for r in near_copies.near_copy_groups(rows(spark, odd)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, 3), (None, None), (5, 5), (6, 5)}
    kept = near_copies.one_of_each(rows(spark, odd))
    assert kept.columns == ["doc_id", "text", "id", "FP", "TEXT2"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 5, None]
    assert near_copies.one_of_each(rows(spark, [])).collect() == []


def test_one_row_of_each_group_stays_whatever_its_doc_id(spark):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    # c and e share doc_id 7, and c's near copy has a smaller one; a and b are alone without doc_ids
    given = [(None, a), (None, b), (None, b), (None, f"{d} more"), (2, d), (3, f"{c} more"), (7, c), (7, e), (7, e)]
    kept = sorted(((r.doc_id, r.text) for r in near_copies.one_of_each(rows(spark, given)).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (2, d), (3, f"{c} more"), (7, e)], key=str)
