"""Empty tables, repeated rows, long texts, clashing names, several shards: every operator has a defined result."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinequery.llm import chat, decontam, quality, queries, secrets, sentencepiece, shuffle, substring, topk, toxicity

CLASH = "doc_id long, text string, row int, spans string, base string, kind int, bucket int, tie int, place int, heavy int, position int, id int, hash int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, *[7] * 1, "s", "b", *[7] * 8) for i, t in texts], CLASH)


def test_topk_over_many_shards(spark):
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(400, 6))).astype(int)
    rows = [(i, (x / 256).tolist(), 1, 2) for i, x in enumerate(v)]
    df = spark.createDataFrame([(i, [float(y) for y in x], a, b) for i, x, a, b in rows], "vec_id long, embedding array<double>, shard int, kind int")
    got = topk.exact_topk(df, "vec_id % 50 = 0", k=5, shard_rows=30).collect()
    for q in range(0, 400, 50):
        s = v @ v[q]
        want = sorted((-s[i], i) for i in range(400) if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert topk.exact_topk(df.limit(0), "vec_id % 50 = 0").collect() == []


def test_topk_ranks_rows_that_share_an_id_apart(spark):
    rows = [(0, [1.0]), (0, [2.0]), (0, [2.0]), (1, [1.0]), (1, [1.0])]
    got = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0", k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted([(0, 1, 0, 131072), (0, 2, 1, 65536), (0, 1, 0, 131072), (0, 2, 1, 131072)])


def test_secrets_of_odd_tables(spark):
    text = "token: abcdefgh " * 3
    d = docs(spark, [(1, text), (1, text), (None, text), (2, "x" * 300_000)])
    out = secrets.scan(d).collect()
    assert [len(r.spans) for r in sorted(out, key=lambda r: str(r.doc_id))] == [3, 3, 0, 3]
    kept = secrets.redact(d)
    assert kept.columns == d.columns and sorted(len(r.text) for r in kept.collect())[-1] == 300_000
    assert secrets.scan(d.limit(0)).collect() == [] and secrets.redact(d.limit(0)).collect() == []


def test_secrets_take_time_in_proportion_to_spans(spark):
    took = {}
    for n in (500, 4000, 16000):
        text = "".join(f"token={'a' * 8}{k:06d} AKIA{'A1' * 9} https://h.example.com/{k} \n" for k in range(n // 4))
        d = docs(spark, [(1, text)]).cache()
        d.count()
        began = time.perf_counter()
        (r,) = secrets.redact(d).select(F.length("text").alias("n"), F.size(F.split("text", r"\[SECRET\]")).alias("k")).collect()
        took[n] = time.perf_counter() - began
        assert r.k > n // 2
    assert took[16000] < 12 * max(took[4000], 0.5)


def test_chat_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, loss int"
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}", "x", 1) for t in range(5000)] + [(2, 0, "assistant", "same", "x", 1)] * 3
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(spark.createDataFrame(rows, schema))).collect()}
    assert got[1].n_turns == 5000 and got[2].n_turns == 3 and got[2].loss_chars == 12
    assert chat.conversation_digests(chat.format_turns(spark.createDataFrame([], schema))).collect() == []


def test_equal_rows_are_spread_over_buckets(spark):
    d = docs(spark, [(1, "same text")] * 600 + [(i, f"t{i}") for i in range(2, 200)]).withColumn("size", F.lit(10).cast("long"))
    out = shuffle.shuffled_shards(d, "size", ["doc_id", "text"], 8, bucket_bytes=500)
    assert out.columns == [*d.columns, "shard", "slot"]
    rows = out.collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(8)]
    assert sum(sizes) == 798 and max(sizes) - min(sizes) <= 1
    assert max(sum(r.shard == s and r.doc_id == 1 for r in rows) for s in range(8)) < 100


def test_substrings_over_many_shards_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(70)]
    texts = []
    for n in range(60):
        own = [f"w{x}" for x in rng.integers(0, 4000, 60)]
        a, b = sorted(rng.integers(0, 70, 2))
        texts.append((n, " ".join(own + passage[a:b] + own[:30] * (n % 2))))
    got = substring.kept_digest(substring.substring_dedup(docs(spark, texts))).collect()
    assert sorted(map(tuple, got)) == sorted(substring.brute_force(texts))


@pytest.mark.parametrize("none", [True, False])
def test_scores_of_empty_and_repeated_documents(spark, none):
    d = docs(spark, [] if none else [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (2, None)])
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    n = 0 if none else 5
    for f in (toxicity.toxicity, quality.quality):
        rows = f(d, labels).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert toxicity.clean_documents(d, labels).columns == d.columns
    assert sentencepiece.tokenize(d, queries.MODEL_PATH).count() == n


def test_decontamination_of_odd_tables(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "北京是中国的首都城市"), (3, None), (4, "two words")], "item_id long, text string")
    rows = [(1, "x alpha beta gamma delta epsilon y")] * 2 + [(None, "alpha beta gamma delta epsilon"), (2, "我知道北京是中国的首都城市吗"), (3, None), (4, "two words")]
    got = sorted((str(r.doc_id), r.item_id) for r in decontam.contaminated(docs(spark, rows), items).collect())
    assert got == [("1", 1), ("1", 1), ("2", 2), ("None", 1)]
    assert decontam.contaminated(docs(spark, []), items).collect() == []
    assert sorted(r.doc_id for r in decontam.clean_documents(docs(spark, rows), items).collect()) == [3, 4]
