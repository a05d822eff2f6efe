"""Text search against a plain version, and how often it reads the records."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cinequery.functions import text
from cinequery.operators import bm25, preprocess, search


def plain_search(docs, queries, limit):
    """Rows (query_id, doc, rank, score, matched) of records (doc, words, quality) for queries (query_id, words), word by word."""
    terms = {d: [w for w in words if len(w) > 1 and w not in text.STOP_WORDS] for d, words, _ in docs}
    df = Counter(t for words in terms.values() for t in set(words))
    average = max(1.0, sum(map(len, terms.values())) / len(docs))
    out = []
    for query_id, words in queries:
        asked = [w for w in words if len(w) > 1 and w not in text.STOP_WORDS]
        groups = [(t, *text.ALIASES.get(t, ())) for t in asked]
        times = Counter(t for g in groups for t in g)
        found = []
        for d, body, quality in docs:
            f = Counter(terms[d])
            matched = sum(any(t in f for t in g) for g in groups)
            if not matched or quality < bm25.LEAST_QUALITY or matched < (1 if len(groups) <= 2 else max(2, math.ceil(len(groups) * 35 / 100))):
                continue
            raw = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * f[t] * 2.2 / (f[t] + 1.2 * (0.25 + 0.75 * len(terms[d]) / average)) * min(n, f[t]) for t, n in times.items() if t in f)
            whole, flat, norm = " ".join(words), " ".join(asked), " ".join(body)
            boost = 2.0 if len(whole) >= 6 and whole in norm else 1.65 if len(flat) >= 6 and flat in norm else 1.0
            found.append((raw * (1 + 0.75 * matched / len(groups)) * boost * quality, matched, d))
        best = sorted(found, key=lambda x: (-round(x[0], 9), -x[1], -x[2]))[:limit]
        out += [(query_id, d, k, round(s / max(found)[0], 6), m) for k, (s, m, d) in enumerate(best, 1)]
    return out


WORDS = ["red", "door", "doors", "hat", "the", "warning", "canh", "bao", "exit", "loi", "x", "green", "of", "indoor"]


@pytest.mark.parametrize("bounds", [{}, {"BLOCK_QUERIES": 3, "CELLS": 50}])
def test_search_equals_plain_version(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(bm25, name, value)
    rng = random.Random(11)
    some = lambda most: [rng.choice(WORDS) for _ in range(rng.randint(0, most))]
    docs = [(d, some(9), rng.choice([0.1, 0.5, 1.0])) for d in range(150)]
    docs += [(d + 1000, words, quality) for d, words, quality in docs[:40]]
    docs += [(2000 + d, ["red", "door"], 1.0) for d in range(30)]  # ties beyond the limit
    queries = [(k, some(6)) for k in range(10)] + [(20, ["red", "door"]), (21, ["the", "red", "door", "of", "green"]), (22, ["red", "hat", "red", "door"])]
    d = spark.createDataFrame([(i, " ".join(w), q) for i, w, q in docs], "doc long, text string, quality double")
    q = spark.createDataFrame([(i, " ".join(w)) for i, w in queries], "query_id int, query string")
    got = bm25.ocr_search(d, q, 12)
    assert dict(got.dtypes)["query_id"] == "int" and dict(got.dtypes)["doc"] == "bigint"
    assert sorted((r.query_id, r.doc, r["rank"], round(r.score, 6), r.matched) for r in got.collect()) == sorted(plain_search(docs, queries, 12))
    assert bm25.ocr_search(d, q.limit(0)).collect() == []


def test_records_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    docs = spark.createDataFrame([(i, f"red door {i}", 1.0) for i in range(100)], "doc long, text string, quality double")
    queries = spark.createDataFrame([(0, "red door"), (1, "door 7")], "query_id int, query string")
    assert bm25.ocr_search(docs.mapInPandas(seen, docs.schema), queries).count() == 200
    assert read.value == 100


def test_folding_moves_no_word_edge(spark):
    df = spark.createDataFrame(list(zip(*text._FOLD, strict=True)), "a string, b string")
    assert df.filter(F.col("a").rlike(r"(?U)\w") != F.col("b").rlike(r"(?U)\w")).count() == 0
    odd = spark.createDataFrame([("Đường Số́ – ÀẸ",), ("plain ASCII",), ("",), (None,)], "t string")
    rows = odd.select(text.normalize("t").alias("n"), text.unmarked("t").alias("u")).collect()
    assert [r.n for r in rows] == ["duong so – ae", "plain ascii", "", None]
    assert [r.n for r in rows[:3]] == [text.folded(r.u) for r in rows[:3]]


def test_quality_needs_no_collapsed_space(spark):
    docs = spark.createDataFrame([("Nguy \n cơ,\tmiền  BẮC",), ("  thời\t\ttiết khu   vực bắc bộ ",), ("cảnh\nbáo sạt lở nguy hiểm miền bắc khu vực",)], "t string").withColumn("s", F.lit(1))
    assert [r[0] for r in docs.select(preprocess.legacy_quality("t", "s")).collect()] == [0.12, 0.05, 1.0]


def test_only_hits_meet_their_places(spark):
    records = spark.createDataFrame([(i, "red door" if i < 3 else "hat", 2, 1.0) for i in range(9)], "doc long, text string, schema int, quality double")
    places = spark.createDataFrame([(i, "v", 10 + i) for i in range(9)], "doc long, video_id string, keyframe_number long")
    mapping = spark.createDataFrame([("v", 10, 100), ("v", 12, 120)], "video_id string, keyframe_number long, frame_id long")
    got = search.text_evidence(records, places, mapping, spark.createDataFrame([(5, "red door")], "query_id long, query string"), 50).collect()
    assert sorted((r.query_id, r.video_id, r.keyframe_number, r.frame_id, r.ocr, r.ocr_text) for r in got) == [(5, "v", 10, 100, 1.0, "red door"), (5, "v", 12, 120, 1.0, "red door")]
