"""Whole queries and the pipeline against plain versions on the smallest tables."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cinequery.llm import decontam, near_copies, quality, queries, secrets, sentencepiece, toxicity

SF = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def toxic(model, text):
    """1 minus the product over sentences of one minus the logistic of the words' weights."""
    none = 1.0
    for sentence in re.split(r"[.!?\n]+", text or ""):
        found = set(re.findall(r"\w+", sentence.lower()))
        if found:
            z = model.bias + sum(model.weights.get(f, 0.0) for w in found for f in [w] + [w[:k] + "*" for k in range(4, 9) if k <= len(w)])
            none *= 1 - 1 / (1 + math.exp(-z))
    return 1 - none


def test_toxicity_equals_plain_scores(spark, model):
    got = {r.doc_id: r for r in queries.QUERIES["op6_toxicity"](spark, SF).collect()}
    for d in table("documents"):
        want = toxic(model, d["text"])
        assert got[d["doc_id"]].score == pytest.approx(want, abs=1e-9) and got[d["doc_id"]].predicted == int(want >= 0.5)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    crc = F.crc32(F.col("doc_id").cast("string"))
    flipped = labels.withColumn("toxic", F.when(crc % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(crc % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert toxicity.train(docs, labels).weights == toxicity.train(docs, flipped).weights
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert a.bias == b.bias and all((x == y).all() for x, y in zip(a.weights, b.weights, strict=True))


def test_quality_equals_plain_scores(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = quality.train(docs, labels)
    got = {r.doc_id: r for r in queries.QUERIES["op10_quality_classifier"](spark, SF).collect()}
    for d in table("documents"):
        x = quality.measures(d["text"])
        z = m.bias + sum(w[sum(v >= e for e in edge)] for v, edge, w in zip(x, m.edges, m.weights, strict=True))
        assert got[d["doc_id"]].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0, 1, (4000, 3)), rng.normal(2.5, 1, (4000, 3))
    for share in (0.3, 0.6, 0.9):
        mixed = np.vstack([good[1000 : 1000 + int(3000 * share)], bad[: 3000 - int(3000 * share)]])
        assert abs(quality.estimated_prior(good[:1000], mixed) - share) < 0.12
    assert quality.estimated_prior(good[:1], good[:1]) == 0.5


def test_shards_hold_every_document_once(spark):
    got = queries.QUERIES["op4_sharding"](spark, SF).collect()
    import zlib

    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in table("documents"))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and all(r.law == "rows" and r.grown_shard is None for r in got)


def held(text, items):
    """Items whose best alignment with the whole text reaches half of a verbatim copy's score."""
    number: dict[bytes, int] = {}
    codes = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
    passage, out = codes(decontam.words(text)), {}
    for k, ws in items.items():
        if len(ws) >= 3 and len(passage) and (score := decontam.align(codes(ws), passage)[0] / (decontam.MATCH * len(ws))) >= 0.5:
            out[k] = score
    return out


def test_decontamination_equals_alignment_of_everything(spark):
    items = {b["item_id"]: decontam.words(b["text"]) for b in table("benchmark")}
    want = {(d["doc_id"], k): s for d in table("documents") for k, s in held(d["text"], items).items()}
    got = {(r.doc_id, r.item_id): r.score for r in queries.QUERIES["op7_benchmark_decontamination"](spark, SF).collect()}
    assert got == want and want


def plain_ids(t, text):
    """Viterbi over all substrings, by a dictionary of pieces; U+2581 in the text goes byte by byte."""
    best = {}
    for i, (p, s, kind) in enumerate(t.pieces):
        if kind == sentencepiece.NORMAL:
            best[p] = (s, i)
    most = max(map(len, best))
    out = []
    for k, part in enumerate(text.split("▁")):
        if k:
            out += [t.byte_ids[b] for b in "▁".encode()]
        s = ("▁" if k == 0 else "") + part.replace(" ", "▁")
        scores, back = [0.0] + [-math.inf] * len(s), [(0, None)] * (len(s) + 1)
        for i in range(len(s)):
            for j in range(i + 1, min(i + most, len(s)) + 1):
                one = best.get(s[i:j])
                value = scores[i] + (one[0] if one else t.unknown_score if j == i + 1 else -math.inf)
                if value > scores[j]:
                    scores[j], back[j] = value, (i, one[1] if one else None)
        at, ids = len(s), []
        while at:
            i, piece = back[at]
            ids = ([piece] if piece is not None else [t.byte_ids[b] for b in s[i:at].encode()]) + ids
            at = i
        out += ids
    return out


def test_pieces_equal_plain_viterbi(spark):
    t = sentencepiece.load(queries.MODEL_PATH)
    got = {r.doc_id: r for r in queries.QUERIES["op8_sentencepiece"](spark, SF).collect()}
    short = [d for d in table("documents") if len(d["text"] or "") < 1500][:40]
    assert len(short) > 20
    for d in short:
        assert list(got[d["doc_id"]].ids) == plain_ids(t, d["text"] or "")
    assert all(r.round_trip for r in got.values())


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints_and_components_equal_plain_ones(spark):
    fps = {d["doc_id"]: plain_fingerprint(d["text"]) for d in table("documents")}
    group = {k: k for k in fps}
    for a in sorted(fps):
        for b in sorted(fps):
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.QUERIES["op9_simhash_near_dedup"](spark, SF).collect()}
    assert got == {k: (fps[k], group[k]) for k in fps}


def plain_spans(text):
    """Spans of all kinds, weak ones only near a part that completes them."""
    found = {k: [(m.start(), m.end(), m) for m in re.finditer(p, text)] for k, p in (("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", secrets.HEX), ("token", secrets.TOKEN), ("endpoint", secrets.ENDPOINT))}
    found["assign"] = [x for x in found["assign"] if len(x[2][2]) >= 6]
    found["token"] = [x for x in found["token"] if all(re.search(c, x[2][0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    near = lambda x, others: any(o[0] - x[1] <= 256 and x[0] - o[1] <= 256 for o in others)
    found["token"] = [x for x in found["token"] if near(x, found["access"])]
    found["endpoint"] = [x for x in found["endpoint"] if near(x, found["access"] + found["assign"])]
    return sorted((a, k, b) for k, kind in enumerate(secrets.KINDS) for a, b, _ in found[kind])


def plain_redacted(text):
    out, at = "", 0
    for a, _, b in plain_spans(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def plain_pipeline(model, docs, items):
    """doc_id to ids; `docs` are (doc_id, text) with different doc_ids."""
    docs = [(i, t) for i, t in docs if toxic(model, t) < 0.5]
    sets = {i: set(near_copies.shingle_set(t, 5).tolist()) for i, t in docs}
    group, by_id = {i: i for i, _ in docs}, sorted(docs)
    for n, (a, s) in enumerate(by_id):
        for b, t in by_id[n + 1 :]:
            both = len(sets[a] & sets[b])
            if (s or "") == (t or "") or (sets[a] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    docs = [(i, t) for i, t in docs if group[i] == i and not held(t, items)]
    t = sentencepiece.load(queries.MODEL_PATH)
    return {i: t.encode(plain_redacted(text or "")).tolist() for i, text in docs}


def test_pipeline_equals_plain_version(spark, model):
    items = {b["item_id"]: decontam.words(b["text"]) for b in table("benchmark")}
    want = plain_pipeline(model, [(d["doc_id"], d["text"]) for d in table("documents")], items)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_pipeline_keeps_odd_rows(spark, tmp_path):
    text = lambda n: " ".join(f"w{n}x{k}" for k in range(40))
    item = table("benchmark")[0]["text"]
    rows = [(1, None, "x"), (None, text(1), "x"), (None, text(2), "x"), (5, text(3), None), (5, text(4), "x"), (5, text(4), "x"), (6, "", "x"), (7, text(3) + " more", "x"), (8, f"{text(5)} {item}", "x"), (9, "w " * 20000, "x")]
    schema = "doc_id long, text string, source string"
    for name, docs in (("odd", rows), ("none", [])):
        spark.createDataFrame(docs, schema).withColumn("id", F.lit("y")).withColumn("hash", F.lit(1)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{name}/{t}.parquet")
    got = sorted((str(r.doc_id), r.n_tokens == 0) for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect())
    assert got == sorted([("1", True), ("None", False), ("None", False), ("5", False), ("5", False), ("9", False)])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
