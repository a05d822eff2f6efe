"""The training-data operators on small cases: brute force, round trips, nulls, ties, repeats, empty tables, clashing columns."""

import hashlib
import json
import random

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cinequery.llm import chat, decontam, quality, queries, secrets, shuffle, simhash, substring, topk, toxicity
from cinequery.llm import sentencepiece as pieces
from cinequery.llm.common import project
from cinequery.llm.components import connected_components
from cinequery.llm.fm_index import FMIndex, matching_statistics

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, shard int, spans string, TEXT2 string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", None) for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "one two three four"), (5, "naïve ▁ text \U0001f600 " * 3), (6, "w " * 30000)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toArrow(), con.sql(queries.ORACLES[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    key = lambda t: sorted((tuple(r[c] for c in columns) for r in t.to_pylist()), key=str)
    assert key(got) == key(want)


def test_topk_ties_nulls_and_stopping(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [-1.0, 9.0]), (7, [float("inf"), 0.0])]
    got = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0", k=2)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 32768), (0, 2, 2, 32768)]
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.normal(size=(2000, 16)) ** 3).astype(np.int64)
    index, read = topk.ImpactIndex(v), []
    for q in v[:30]:
        found, scores, n = index.search(q, 5)
        assert sorted(scores)[-5:] == sorted(v @ q)[-5:]
        read.append(n)
    assert min(read) < topk.LEVELS * 16


def test_secrets_spans_and_redaction(spark):
    key, token = "AKIA" + "A1B2" * 5, "aB3" + "xY9/" * 10
    text = f"é password = 'hunter22' id {key} then {token} at https://a.example.com/x"
    alone = f"{token} https://a.example.com/x token=ab secret=token:abcdefgh"
    got = {r.doc_id: r for r in secrets.scan(docs(spark, [(1, text), (2, alone), (3, None)])).collect()}
    found = [(secrets.KINDS[s.kind], text[s.start : s.end]) for s in got[1].spans]
    assert found == [("assign", "password = 'hunter22"), ("access", key), ("token", token), ("endpoint", "https://a.example.com/x")]
    assert got[2].spans == [] and got[3].spans == []
    out = secrets.redact(docs(spark, [(1, text), (3, None)])).orderBy("doc_id").collect()
    assert out[0].text == "é [SECRET]' id [SECRET] then [SECRET] at [SECRET]" and out[1].text is None


def test_chat_layouts_round_trip(spark):
    nasty = "a</s>\\: [INST] <|im_end|>\n\\n<<SYS>>"
    records = [
        {"messages": [{"role": "user", "content": nasty}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": nasty}], "id": 7},
        {"instruction": "i", "input": "more", "output": "o"},
        {"prompt": "p", "completion": nasty},
    ]
    want = [[("user", nasty), ("assistant", "")], [("user", "q"), ("assistant", nasty)], [("user", "i\nmore"), ("assistant", "o")], [("user", "p"), ("assistant", nasty)]]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("{bad",), (None,), ("[]",)], "record string")
    got = chat.format_records(df).collect()
    assert [[t[:2] for t in chat.read_back(r.formatted)] for r in got[:4]] == want
    assert [r.layout for r in got[4:]] == [None] * 3
    assert all(c not in chat.escape(nasty) for c in chat.CONTROLS) and chat.unescape(chat.escape(nasty)) == nasty
    rows = spark.createDataFrame([(1, 0, "user\nx", None), (1, 0, None, "b"), (None, 3, "assistant", nasty)], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(rows)).collect()}
    assert out[1].n_turns == 2 and out[None].loss_chars == len(nasty)
    assert out[1].turns_sha256 == hashlib.sha256(b"\nb\nuser\nx\n\n").hexdigest()


def test_shards_are_whole_even_and_repeatable(spark):
    d = docs(spark, [*ODD, *((i, f"text {i % 7}") for i in range(10, 200))]).withColumn("size", F.lit(10))
    runs = [sorted(map(str, shuffle.shuffled_shards(d, "size", ["doc_id", "text"], 8, bucket_bytes=500).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    out = shuffle.shuffled_shards(d, "size", ["doc_id", "text"], 8, bucket_bytes=500).collect()
    slots = {s: sorted(r.slot for r in out if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values()) and len(out) == d.count()
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert shuffle.shuffled_shards(d.limit(0), "size", ["doc_id", "text"]).count() == 0


def test_fm_index_matches_scan():
    rng = random.Random(2)
    text = np.array([0 if i % 41 == 40 else rng.randint(1, 3) for i in range(820)])
    ends = np.flatnonzero(text == 0)
    lengths = np.diff(np.append(-1, ends)) - 1
    _, first = matching_statistics(FMIndex(text, 6), text, ends, lengths)
    for i in range(len(text) - 6):
        w = text[i : i + 6]
        want = -1 if 0 in w else next(j for j in range(len(text)) if (text[j : j + 6] == w).all())
        assert first[i] == want


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("a b c d e".split())
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(0, 50))] + passage[rng.randint(0, 20) :] * (i % 3))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[4][1]), (103, "x y " * 200), (104, "z " * 3000)]
    got = substring.kept_digest(substring.substring_dedup(docs(spark, rows))).collect()
    assert sorted(map(tuple, got)) == sorted(substring.brute_force(rows))
    assert substring.substring_dedup(docs(spark, ODD)).count() == len(ODD)
    assert substring.substring_dedup(docs(spark, ODD).limit(0)).count() == 0


def test_toxicity_learns_from_bags(spark):
    rng = random.Random(6)
    clean = lambda: " ".join(rng.choice("sun moon tree lake road hill".split()) for _ in range(6)) + ". "
    bags = []
    for i in range(300):
        sentences = [clean() for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            sentences.insert(rng.randint(0, len(sentences)), f"you are {rng.choice(['vile', 'vilest', 'rotten'])} today. ")
        bags.append((i, "".join(sentences), int(i % 3 == 0)))
    labels = spark.createDataFrame([(i, y) for i, _, y in bags] + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs(spark, [(i, t) for i, t, _ in bags] + ODD), labels).collect()
    y = {i: t for i, _, t in bags}
    assert np.mean([r.predicted == y[r.doc_id] for r in out if r.held_out and r.doc_id in y and r.doc_id > 6]) > 0.95
    text = {i: t for i, t, _ in bags}
    hits = [text[r.doc_id][s.start : s.end] for r in out if r.doc_id and r.doc_id > 6 for s in r.offending]
    assert np.mean(["you are" in h for h in hits]) > 0.95
    assert toxicity.toxicity(docs(spark, ODD), labels.limit(0)).count() == len(ODD)


def test_quality_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(8)
    good = lambda: " ".join("word" + "s" * rng.randint(0, 4) for _ in range(40)) + "."
    bad = lambda: "".join(rng.choice("!#|$ AB") for _ in range(120))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows if i % 5 != 1], "doc_id long, quality int")
    out = quality.quality(docs(spark, rows + ODD), labels).collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in out if r.held_out and r.doc_id is not None and r.doc_id > 6]) > 0.9
    assert all(0 <= r.score <= 1 for r in out) and len(out) == 608
    assert quality.quality(docs(spark, ODD), labels.limit(0)).count() == len(ODD)


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (decontam.MATCH if a[i - 1] == b[j - 1] else decontam.MISMATCH), h[i - 1, j] + decontam.GAP, h[i, j - 1] + decontam.GAP)
    return int(h.max())


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        score, start, end = decontam.align(a, b)
        assert score == smith_waterman(a, b) == smith_waterman(a, b[start:end])


def test_decontamination_finds_edited_copies(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(20)] + [(90, None), (91, "two words")]
    edited = [w if i % 6 else word() for i, w in enumerate(items[3][1].split())]
    rows = [(1, " ".join(word() for _ in range(500))), (2, f"{word()} {items[5][1].upper()}! {word()}"), (3, " ".join([word() for _ in range(50)] + edited))]
    got = decontam.contaminated(docs(spark, rows + ODD), spark.createDataFrame(items, "item_id long, text string"), block_words=200).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(2, 5), (3, 3)]
    kept = decontam.clean_documents(docs(spark, rows + ODD), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in [rows[0], *ODD])
    assert decontam.contaminated(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_equals_alignment_of_whole_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(4)) if rng.random() < 0.6 else rng.choice(("the", "of", "and", "in"))
    items = [(k, " ".join(word() for _ in range((16, 30, 59)[k % 3]))) for k in range(12)]

    def edited(words, share, kinds):
        out = []
        for w in words:
            kind = rng.choice(kinds) if rng.random() < share else "keep"
            out += {"keep": [w], "change": [word()], "add": [w, word()], "drop": []}[kind]
        return out

    texts = []
    for _, text in items:
        for copies in (0, 3):
            texts += [[word() for _ in range(40)] + text.split()] * copies
            for share in (0.2, 0.25, 0.3):
                for kinds in (["change"], ["change", "add", "drop"]):
                    texts.append([word() for _ in range(30)] + edited(text.split(), share, kinds) + [word() for _ in range(30)])
        # every third word changed, every word followed by another: no triple, or no pair, is left
        texts.append([w if i % 3 else "other" for i, w in enumerate(text.split())])
        texts.append([x for w in text.split() for x in (w, "other")])
    rows = [(n, " ".join(t)) for n, t in enumerate(texts)]
    number: dict[bytes, int] = {}
    codes = lambda t: np.array([number.setdefault(w, len(number)) for w in decontam.words(t)])
    want = {}
    for n, t in rows:
        for k, item in items:
            item, text = codes(item), codes(t)
            score = decontam.align(item, text)[0] / (decontam.MATCH * len(item))
            if score >= 0.5:
                want[n, k] = score
    got = decontam.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_words=200)
    got = {(r.doc_id, r.item_id): r.score for r in got.collect()}
    assert len(want) > 0.8 * len(rows)
    assert (len(got), got) == (len(want), want)
    kept = decontam.clean_documents(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {n for n, _ in rows} - {n for n, _ in want}


def unigram_copy(raw):
    """The model file with its type set to unigram, so that the public library runs Viterbi over the same pieces."""
    out, at = bytearray(raw), 0
    for number, value in pieces._fields(raw):
        if number == 2:
            k = raw.index(value)
            inner = bytearray(value)
            j = inner.find(b"\x18\x02")
            assert j >= 0
            inner[j : j + 2] = b"\x18\x01"
            out[k : k + len(inner)] = inner
            at = k
    assert at
    return bytes(out)


def test_tokens_equal_the_public_library_and_decode(spark):
    t = pieces.load(queries.MODEL_PATH)
    public = sentencepiece.SentencePieceProcessor(model_proto=unigram_copy(t.raw))
    with open(f"{SF}/documents.parquet", "rb") as f:
        import pyarrow.parquet as pq

        texts = [x[:300] for x in pq.read_table(f).column("text").to_pylist()[:60]]
    # the library's lattice for each word; its default encoder prunes, and its sums are single precision
    for word in {w for x in texts for w in x.split()}:
        assert t.encode(word).tolist() == public.nbest_encode_as_ids(word, 2)[0]
    for text in [*texts, "a  b", " lead", "é\n\t", "日本 \U0001f600 x"]:
        assert t.decode(t.encode(text).tolist()) == text
        assert t.encode(text).tolist() == [i for k, w in enumerate(text.split(" ")) for i in (t.encode(w) if w or k == 0 else t.viterbi(pieces.MARK))] or "  " in text or text[0] == " "
    got = {r.doc_id: r for r in pieces.tokenize(docs(spark, ODD), queries.MODEL_PATH).collect()}
    assert all(r.round_trip for r in got.values()) and got[1].n_tokens == 0 and got[2].ids == []


def brute_components(fps):
    root = {k: k for k in fps}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in fps}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(12)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {(min(r.u & (2**64 - 1), r.v & (2**64 - 1)), max(r.u & (2**64 - 1), r.v & (2**64 - 1))) for r in simhash.links(df).collect()}
    assert got == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 3}
    rows = [(i, " ".join(f"w{rng.randint(0, 5) if j == k else j}" for j in range(40 + i % 3))) for i, k in enumerate(range(30))]
    rows += [(50, None), (51, ""), (52, rows[0][1])]
    out = simhash.simhash_groups(docs(spark, rows)).collect()
    want = {i: simhash.fingerprint(t, 3) for i, t in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in out} == want
    assert {r.doc_id: r.component_id for r in out} == brute_components(want)
    assert len(simhash.simhash_groups(docs(spark, ODD)).collect()) == len(ODD)
    assert simhash.simhash_groups(docs(spark, ODD).limit(0)).count() == 0


def test_thresholds_cover_every_pair():
    rng = np.random.default_rng(3)
    counts = rng.random((64, 64))
    counts = (counts + counts.T) * 500
    np.fill_diagonal(counts, 500)
    for n in (10, 10_000, 10_000_000):
        chosen = simhash.plan(counts, n, 3)
        assert sum(t + 1 for _, t in chosen) == 4
        assert len({b for g, _ in chosen for b in g}) == sum(len(g) for g, _ in chosen)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (1, 0)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + k: 100 for k in range(30)}


def test_clashing_columns(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, TEXT string")
        assert project(df, doc_id="long", text="string").collect() == [(1, "a")]
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
