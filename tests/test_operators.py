"""Hand-made cases, and randomised ones against brute force."""

import itertools
import random

import pytest

from cinequery.functions import text
from cinequery.operators import alignment, bm25, evaluation, fusion, language, models, preprocess, qa, refine, router, search, select, trake, vector


def test_alignment_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(v, i, rng.randint(0, 9) * 1.0, rng.randint(0, 9) * 1.0, rng.randint(0, 9) * 1.0) for v in range(8) for i in range(v)]
    got = {r.v: r.total for r in alignment.ordered_alignment(spark.createDataFrame(rows, "v int, i int, a double, b double, c double"), ["v"], "i", ["a", "b", "c"]).collect()}
    for v in range(8):
        s = [r[2:] for r in rows if r[0] == v]
        best = max((s[i][0] + s[j][1] + s[k][2] for i, j, k in itertools.combinations(range(len(s)), 3)), default=None)
        assert got.get(v) == best


def test_alignment_takes_earliest_frames(spark):
    rows = [(0, 0, 1.0, 0.0), (0, 1, 1.0, 1.0), (0, 2, 0.0, 1.0)]
    assert alignment.ordered_alignment(spark.createDataFrame(rows, "v int, i int, a double, b double"), ["v"], "i", ["a", "b"]).first().path == [0, 1]


def test_candidate_alignment_needs_every_event(spark):
    schema = "v string, event int, frame_id long, score double"
    rows = [("x", 0, 10, 0.5), ("x", 1, 10, 0.9), ("x", 1, 20, 0.4), ("y", 0, 1, 1.0), ("z", 0, 1, float("nan")), ("z", 1, 2, 1.0)]
    got = alignment.candidate_alignment(spark.createDataFrame(rows, schema), ["v"], 2).collect()
    assert [(r.v, round(r.total, 6), r.path) for r in got] == [("x", 0.9, [10, 20])]


def test_greedy_equals_loop(spark):
    rng = random.Random(5)
    rows = [(g, f, float(rng.randint(0, 20))) for g in range(5) for f in rng.sample(range(300), 40)]
    got = {(r.g, r.f) for r in select.greedy_gap(spark.createDataFrame(rows, "g int, f long, s double"), ["g"], "f", "s", 15, 4).collect()}
    want = set()
    for g in range(5):
        kept = []
        for _, f in sorted((-s, f) for h, f, s in rows if h == g):
            if len(kept) < 4 and all(abs(f - k) > 15 for k in kept):
                kept.append(f)
        want |= {(g, f) for f in kept}
    assert got == want


def test_sampler_and_schedule(spark):
    frames = spark.range(70).withColumnRenamed("id", "f")
    assert [r.f for r in frames.filter(preprocess.sampled_frame("f", 30, 2)).orderBy("f").collect()] == [0, 15, 30, 45, 60]
    assert refine.modulo_schedule("4,2,1") == [4, 2, 1]
    for bad in ("4,3,1", "4,2", "1,2", "600,1"):
        with pytest.raises(ValueError):
            refine.modulo_schedule(bad)
    base = spark.range(20).selectExpr("'v' video_id", "id frame_id")
    chosen = spark.createDataFrame([("v", 4), ("v", 8)], "video_id string, frame_id long")
    fine = refine.refine(base, refine.refine(base, chosen, 4, 2), 2, 1)
    assert [r.frame_id for r in fine.orderBy("frame_id").collect()] == list(range(15))


def test_final_score_and_answers(spark):
    scores = spark.createDataFrame([(1, 1, 0.5), (1, 3, 0.8)], "query_id int, rank int, score double")
    assert evaluation.recall_at(scores).first().final_score == pytest.approx(0.74)
    df = spark.createDataFrame([("Năm",), ("five",), ("5",), ("Màu  Đỏ",), ("",)], "a string")
    assert [r[0] for r in df.select(evaluation.normalize_answer("a")).collect()] == ["5", "5", "5", "do", ""]


def test_quality_and_boxes(spark):
    ticker = "Nguy cơ lũ quét vùng núi miền Bắc"
    df = spark.createDataFrame([(ticker, 1), (ticker, 2), ("nguy co, mien bac", 1), ("CẢNH BÁO sạt lở nguy hiểm, miền Bắc, vùng núi, khu vực", 1), ("", 1)], "t string, s int")
    assert [r[0] for r in df.select(preprocess.legacy_quality("t", "s")).collect()] == [0.05, 1.0, 0.12, 1.0, 1.0]


def test_text(spark):
    df = spark.createDataFrame([("Đường  Số́ 5",), (None,)], "t string")
    assert [r[0] for r in df.select(text.squeezed("t")).collect()] == ["duong so 5", None]
    assert df.select(text.terms("t")).first()[0] == ["duong", "so"]


def test_sequence_refinement_equals_brute_force(spark):
    rng = random.Random(7)
    scores = {(v, f): tuple(rng.random() for _ in range(3)) for v in "abcdefgh" for f in range(rng.randint(5, 40))}
    df = spark.createDataFrame([(v, f, *s) for (v, f), s in scores.items()], "video_id string, frame_id long, s0 double, s1 double, s2 double")
    got = {r.video_id: (r.path, round(r.score, 9), r["rank"]) for r in refine.refine_sequences(df, 3, [4, 2, 1], 4, 6).collect()}

    def best(v, choices):
        paths = [p for p in itertools.product(*choices) if p[0] < p[1] < p[2]]
        return max(paths, key=lambda p: sum(scores[v, f][e] for e, f in enumerate(p)), default=None)

    def judge(v, p):
        x = [scores[v, f][e] for e, f in enumerate(p)]
        return 0.72 * sum(x) / 3 + 0.28 * min(x)

    frames = {v: [f for w, f in scores if w == v] for v in "abcdefgh"}
    coarse = {v: p for v in frames if (p := best(v, [[f for f in frames[v] if f % 4 == 0]] * 3))}
    kept = dict(sorted(coarse.items(), key=lambda i: (-judge(*i), i[0]))[:6])
    for previous, step in ((4, 2), (2, 1)):
        for v, p in kept.items():
            kept[v] = best(v, [[f for f in frames[v] if abs(f - c) <= previous and f % step == 0] for c in p]) or p
    want = sorted(kept.items(), key=lambda i: (-judge(*i), i[0]))[:4]
    assert got == {v: (list(p), round(judge(v, p), 9), k) for k, (v, p) in enumerate(want, 1)}


def test_quota_pool_keeps_text_row_and_skips_nulls(spark):
    rows = [(1, f"v{i}", i, 0, i, None, 0.0, 1.0 - i / 10) for i in range(3)] + [(1, "w", 9, 0, None, 1, None, None)]
    schema = "q int, video_id string, key long, frame_id long, visual_rank int, ocr_rank int, metadata_score double, score double"
    got = select.quota_pool(spark.createDataFrame(rows, schema), ["q"], 4, select.shares(0.55, 0.30, 0.10, 0.0, 4), None, 0).collect()
    assert sorted(r.video_id for r in got) == ["v0", "v1", "v2", "w"] and sorted(r.place for r in got) == [1, 2, 3, 4]
    one = [(1, "v", i, i, i, None, 0.0, 0.5) for i in range(6)]
    pool = select.quota_pool(spark.createDataFrame(one, schema), ["q"], 5, (3, 1, 1), 2, 30)
    assert pool.count() == 5  # one burst in one video: the rest of the budget fills without diversity
    assert select.shares(0.0, 0.0, 0.0, 0.0, 5) == (2, 1, 1)


def test_clauses_and_source_queries(spark):
    text = "Một biển báo màu vàng bên đường. Biển có nội dung là cảnh báo sạt lở"
    df = spark.createDataFrame([(text,), (None,), ("  ",), ("...",)], "q string").withColumn("c", router.clauses("q")).withColumn("s", router.scored_clauses("c"))
    r = df.select("c", router.weights("s").alias("w"), router.query_for("s", "visual").alias("v"), router.query_for("s", "ocr").alias("o")).collect()
    assert [tuple(c) for c in r[0].c] == [("Một biển báo màu vàng bên đường", ""), ("Biển", ""), ("cảnh báo sạt lở", "ocr")]
    assert r[0].v.startswith("Một biển báo màu vàng bên đường") and r[0].o == "cảnh báo sạt lở"
    assert sum(r[0].w) == pytest.approx(1.0)
    assert [len(x.c) for x in r] == [3, 0, 0, 1] and r[1].w is None
    intents = spark.createDataFrame([("a logo",), ("he said 'go now' to her",), ("STOP HERE",), ("a red car",), (None,)], "q string")
    assert [x[0] for x in intents.select(router.explicit_ocr("q")).collect()] == [True, True, True, False, False]


def test_event_prompts(spark):
    prompts = ["Tìm video\nSự kiện 2 — Cắt: b\nEvent 1: a", "1. x\r\n2. y\n3. z", "- one\n• two", "Event 1: a\nEvent 1: b", "single", None]
    got = spark.createDataFrame([(p,) for p in prompts], "p string").select(router.events("p").alias("e")).collect()
    assert [(r.e.events, r.e.problem) for r in got] == [(["a", "Cắt: b"], ""), (["x", "y", "z"], ""), (["one", "two"], ""), (["a", "b"], "duplicate"), (["single"], "few"), ([], "few")]


def test_event_truth_and_rerank_scores(spark):
    iv = [(95, 105), (145, 155), (195, 205), (245, 255)]
    truth = spark.createDataFrame([(1, "a", iv), (2, "a", [])], "query_id int, video_id string, intervals array<struct<start:int,end:int>>")
    p = [(1, 1, "a", ["101", "156", "203.0", "251"]), (1, 2, "b", ["101"]), (1, 3, "a", ["100", None]), (2, 1, "a", ["1"]), (3, 1, "a", ["1"])]
    got = evaluation.event_scores(spark.createDataFrame(p, "query_id int, rank int, video_id string, frames array<string>"), truth).collect()
    assert {(r.query_id, r["rank"]): r.score for r in got} == {(1, 1): 0.75, (1, 2): 0.0, (1, 3): 0.25, (2, 1): 0.0, (3, 1): 0.0}
    rows = spark.createDataFrame([(0.96, 0.20, 0.45, False), (0.86, 0.84, 0.62, False), (0.90, 0.30, 0.70, True), (0.80, 0.85, 0.25, True)], "j double, v double, s double, e boolean")
    a, b, c, d = [r[0] for r in rows.select(fusion.rerank_score(*(rows[x] for x in "jvse"))).collect()]
    assert b > a and c > d
    capped = fusion.cap_outside(spark.createDataFrame([(1, True, 0.5), (1, False, 0.9), (1, False, 0.1), (2, False, 0.9)], "q int, p boolean, s double"), ["q"], "p", "s")
    assert sorted((r.q, r.s) for r in capped.collect()) == [(1, 0.1), (1, 0.499), (1, 0.5), (2, 0.9)]


def test_models_score_distinct_inputs(spark):
    pairs = spark.createDataFrame([(1, "a b", "b c"), (2, "a b", "b c"), (3, "", "x"), (4, None, None)], "i int, query string, text string")
    assert {r.i: r.score for r in models.score_pairs(pairs, models.TokenOverlap).collect()} == {1: 0.5, 2: 0.5, 3: 0.0, 4: 0.0}

    class Length:
        def encode(self, texts):
            return [[float(len(t))] for t in texts]

        def answer(self, questions, evidence):
            return [(e, 0.5) for e in evidence]

    assert sorted(r.embedding[0] for r in models.encode_texts(pairs, Length).collect()) == [1.0, 3.0]
    asked = spark.createDataFrame([("q", "yes"), ("q", None)], "question string, evidence string")
    assert sorted((r.answer, r.confidence) for r in models.answer_questions(asked, Length).collect()) == [("", 0.5), ("yes", 0.5)]


def test_greedy_needs_no_more_frames_than_can_be_shut_out(spark):
    rows = [("v", f, 1000.0 - f) for f in range(900)] + [("w", 5, 1.0), ("w", 5, 2.0), ("w", None, 3.0)]
    got = select.greedy_gap(spark.createDataFrame(rows, "g string, f long, s double"), ["g"], "f", "s", 90, 4).collect()
    assert sorted((r.g, r.f, r.s) for r in got) == [("v", 0, 1000.0), ("v", 91, 909.0), ("v", 182, 818.0), ("v", 273, 727.0), ("w", 5, 2.0)]


def test_recall_equals_expressions(spark):
    rng = random.Random(4)
    frames = [(f"v{i % 3}", i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(200)] + [("v0", 900, None), ("v0", 901, [1.0, None, 0.0, 0.0]), ("v0", 902, [0.0] * 4)]
    f = spark.createDataFrame(frames, "video_id string, feature_index long, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(k, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(3)], "query_id long, qvec array<double>")
    got = {(r.query_id, r.feature_index): round(r.score, 9) for r in vector.recall(f, q, 20).collect()}
    plain = vector.scored(f.filter("embedding is not null and not array_contains(transform(embedding, x -> x is null), true)"), q)
    want = vector.top_per_group(plain, 20, ["query_id"], vector.F.desc("score"), vector.F.col("video_id"), vector.F.col("feature_index")).collect()
    assert got == {(r.query_id, r.feature_index): round(r.score, 9) for r in want} and len(got) == 60
    assert vector.recall(f, q.limit(0), 20).collect() == []


def test_signs_rank_first_and_tickers_are_left_out(spark):
    texts = ["CẢNH BÁO nguy hiểm sạt lở", "thời tiết hôm nay nắng", "tin bóng đá trong nước", "cảnh báo nguy cơ lũ quét vùng núi miền Bắc mưa lớn diện rộng"]
    docs = spark.createDataFrame([(i, t, 1 if i == 3 else 2) for i, t in enumerate(texts)] + [(4, None, 2)], "doc long, text string, schema int").withColumn("quality", preprocess.legacy_quality("text", "schema"))
    queries = spark.createDataFrame([(0, "cảnh báo sạt lở"), (1, "warning danger landslide"), (2, None), (3, "the")], "query_id int, query string")
    got = bm25.ocr_search(docs, queries).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc) for r in got if r["rank"] == 1] == [(0, 0), (1, 0)]
    assert all(r.doc != 3 for r in got)
    twins = spark.createDataFrame([(i, "red door", 1.0) for i in range(3)], "doc long, text string, quality double")
    assert [r.doc for r in bm25.ocr_search(twins, queries.limit(1).selectExpr("query_id", "'red door' query")).orderBy("rank").collect()] == [2, 1, 0]


def test_rare_metadata_wins_and_others_score_0(spark):
    docs = spark.createDataFrame([(0, "daily news"), (1, "daily aurora report"), (2, "cooking"), (3, None)], "doc long, text string")
    got = {r.doc: r.score for r in bm25.metadata_search(docs, spark.createDataFrame([(0, "daily aurora")], "query_id int, query string")).collect()}
    assert got[1] == 1.0 and 0 < got[0] < 1 and got[2] == got[3] == 0.0


def test_options_are_cut_to_their_bounds():
    assert search.Options.clamped("500", "-3", "0") == search.Options(100, 0, None)
    assert search.Options.clamped(None, "x", "7") == search.Options(100, 0, 7)
    for bad in ({"top_k": 0}, {"min_gap": -1}, {"max_per_video": 0}):
        with pytest.raises(ValueError):
            search.Options(**bad)
    assert (search.recall_pool(10), search.recall_pool(100, "one"), search.refine_pool(100)) == (800, 24000, 3000)
    assert trake.budgeted(32, 5, 10) == 6 and trake.budgeted(1, 5, 10) == 1 and trake.budgeted(32, 3, 0) == 0


def test_unknown_videos_are_an_error(spark):
    f = spark.createDataFrame([("a", 1)], "video_id string, frame_id long")
    assert search.only_video(f, "a").count() == 1 and search.only_video(f, None).count() == 1
    with pytest.raises(ValueError):
        search.only_video(f, "b")
    with pytest.raises(ValueError):
        select.video_window(f.union(f), 1)


def test_sources_are_asked_once_and_fall_back_to_the_query(spark):
    q = spark.createDataFrame([(0, "a man wearing a hat. video title Aurora"), (1, "!!!"), (2, None)], "query_id long, query string")
    got = search.source_queries(search.analysed(q)).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.source) for r in got if r.query_id == 0] == [(0, "object"), (0, "metadata")] or got[0].source == "visual"
    assert [(r.source, r["query"]) for r in got if r.query_id == 2] == [("visual", "")]
    weights = {r.source: r.metadata_weight for r in got if r.query_id == 0}
    assert weights["metadata"] > 0.025


def test_merged_results_take_the_best_of_each_source(spark):
    rows = [(1, 0, "v", 3, 30, "", ["a"], 0.5, 0.1, 0.0, 0.4), (1, 1, "v", 3, 30, "T", ["b", "a"], 0.2, 0.9, 0.3, 0.6)]
    df = spark.createDataFrame(rows, "query_id long, place int, video_id string, keyframe_number long, frame_id long, title string, labels array<string>, visual double, metadata double, object double, score double")
    r = search.merged(df).first()
    assert (r.title, r.labels, r.visual, r.metadata, r.object, r.score) == ("T", ["a", "b"], 0.5, 0.9, 0.3, 0.6)


def test_kinds_answers_and_confidence(spark):
    q = ["Bao nhiêu người?", "what is the man holding", "áo màu gì", "where", None, "the accountant"]
    df = spark.createDataFrame([(x,) for x in q], "q string")
    assert [r[0] for r in df.select(qa.question_kind("q")).collect()] == ["count", "holding", "appearance", "general", "general", "general"]
    a = [("There are two people.", "count"), ("Answer: 12 or 13", "count"), ("the red-shirted person is holding a microphone.", "holding"), ("đáp án - ", "general"), (None, "count"), ("red", "general")]
    got = [r[0] for r in spark.createDataFrame(a, "a string, k string").select(qa.normal_answer("a", "k")).collect()]
    assert got == ["2", "12", "microphone", "unknown", "unknown", "red"]
    p = spark.createDataFrame([([0.5, 0.5],), ([],), ([0.0],)], "p array<double>").select(qa.token_confidence("p")).collect()
    assert [round(r[0], 9) for r in p] == [0.5, 0.0, 1e-8]
    assert "Arabic integer" in df.select(qa.prompt("q")).first()[0]
    s = spark.createDataFrame([("Trao giải. Câu hỏi: mấy người?",), ("plain",), (" Question: x",), (None,)], "q string").select(qa.split("q").alias("s")).collect()
    assert [tuple(r.s) for r in s] == [("Trao giải", "mấy người?", ""), ("plain", "plain", ""), ("", "x", "half"), ("", "", "empty")]


def test_blank_results_take_the_agreed_answer(spark):
    results = spark.createDataFrame([(1, r, "v") for r in range(1, 5)] + [(2, 1, "w")], "query_id long, rank int, video_id string")
    p = spark.createDataFrame([(1, 1, "Two", 0.4, "count"), (1, 2, "2", 0.5, "count"), (1, 3, "9", 0.6, "count")], "query_id long, rank int, answer string, confidence double, kind string")
    got = {(r.query_id, r["rank"]): (r.answer, r.qa_confidence) for r in qa.filled(results, p).collect()}
    assert got == {(1, 1): ("Two", 0.4), (1, 2): ("2", 0.5), (1, 3): ("9", 0.6), (1, 4): ("Two", 0.5), (2, 1): (None, None)}


def test_answers_count_only_in_their_place(spark):
    preds = spark.createDataFrame([(1, 1, "a", "505", "Năm"), (1, 2, "a", "600", "5"), (1, 3, "a", "x", "5"), (1, 4, "a", "505", "")], "query_id long, rank int, video_id string, frame_id string, answer string")
    truth = spark.createDataFrame([(1, "a", 500, 510)], "query_id long, video_id string, start long, end long")
    answers = spark.createDataFrame([(1, ["5", "five"])], "query_id long, answers array<string>")
    assert [r.score for r in evaluation.qa_scores(preds, truth, answers).orderBy("rank").collect()] == [1.0, 0.0, 0.0, 0.0]


def test_small_texts(spark):
    df = spark.createDataFrame([("tìm cảnh",), ("tim canh bao",), ("a red car",), (None,)], "q string")
    assert [r[0] for r in df.select(language.looks_vietnamese("q")).collect()] == [True, True, False, False]
    t = language.for_model(df.withColumnRenamed("q", "query"), lambda q: q.filter("query like 'tim %'").withColumn("english", vector.F.lit("find")))
    assert sorted((r["query"] or "", r.language, r.translated) for r in t.collect()) == [("", "en", False), ("a red car", "en", False), ("tim canh bao", "vi", True), ("tìm cảnh", "vi", False)]
    w = spark.createDataFrame([("a landslide warning",), ("a sign that says landslide",), ("a car",)], "q string")
    assert [r[0] for r in w.select(language.ambiguous_warning("q")).collect()] == [True, False, False]
    assert [r[0] for r in spark.createDataFrame([("He LANDS softly",), ("người Tiếp đất",), ("run",)], "q string").select(language.landing("q")).collect()] == [True, True, False]
    times = spark.createDataFrame([(0.0,), (61.5,), (-3.0,), (600.0625,)], "t double").select(language.time_label(vector.F.col("t")), *language.shown("t")).collect()
    assert [r[0] for r in times] [:3] == ["00:00.000", "01:01.500", "00:00.000"]
    assert times[3][1] == 600.062
    r = spark.createDataFrame([(1, "L01", 7, 3, 0.5, 0.25, 0.1, 0.12345678, "T", ["a"] * 9, "x", 0.5), (2, "L01", 7, 3, 0.5, 0.25, 0.1, 0.5, "T", [], "", 0.0)], "rank int, video_id string, frame_id long, keyframe_number long, pts_time double, visual double, metadata double, score double, title string, labels array<string>, answer string, qa_confidence double")
    c = [x[0] for x in r.select(language.caption()).collect()]
    assert c[0] == "#1 | L01.mp4 | frame 7 | 0.50s | score 0.1235\nT\nObjects: a, a, a, a, a, a\nQ&A: x (50%)" and c[1].endswith("no object metadata")
    assert language.table_row(r).first().score == 0.12346


def test_model_scores_shift_clauses(spark):
    df = spark.createDataFrame([("a quiet street", [(0.1, 0.9, 0.1, 0.1)])], "q string, m array<struct<visual:double,ocr:double,metadata:double,object:double>>")
    df = df.withColumn("c", router.clauses("q"))
    lexical, model = df.select(router.scored_clauses("c")[0].scores.ocr, router.scored_clauses("c", "m")[0].scores.ocr).first()
    assert model > 0.5 > lexical


def test_frame_text_is_split_by_place(spark):
    box = lambda x0, y0, x1, y1, t, c=0.9: ([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], t, c)
    boxes = [box(20.0, 650.0, 1260.0, 700.0, " breaking news "), box(300.0, 180.0, 900.0, 270.0, "DANGER"), box(300.0, 300.0, 900.0, 380.0, "DANGER"), box(1.0, 1.0, 9.0, 9.0, "low", 0.1), ([[1.0]], "odd", 0.9), (None, "none", 0.9)]
    df = spark.createDataFrame([(boxes,), (None,)], "b array<struct<polygon:array<array<double>>,text:string,confidence:double>>")
    got = [tuple(r.f) for r in df.select(preprocess.frame_text("b", vector.F.lit(1280), vector.F.lit(720)).alias("f")).collect()]
    assert got == [("DANGER odd none", "breaking news", 4, 1), ("", "", 0, 0)]


def test_sequence_rerank_equals_plain_version(spark):
    rng = random.Random(9)
    frames = {v: rng.randint(6, 14) for v in "abcdefgh"}
    value = {(v, k, e): rng.random() for v, n in frames.items() for k in range(n) for e in range(3)}
    mapping = spark.createDataFrame([(v, k * 10, k) for v, n in frames.items() for k in range(n)], "video_id string, keyframe_number long, x long")
    seqs = [(i + 1, v, rng.random(), sorted(rng.sample(range(frames[v]), 3))) for i, v in enumerate(frames)]
    sequences = spark.createDataFrame([(r, v, s, [k * 10 for k in p]) for r, v, s, p in seqs], "rank int, video_id string, score double, keyframes array<long>")
    events = spark.createDataFrame([(0, "a", False), (1, "b", False), (2, "lands", True)], "event int, stage string, landing boolean")
    values = spark.createDataFrame([(v, k * 10, e, x) for (v, k, e), x in value.items()], "video_id string, keyframe_number long, event int, value double")
    got = trake.rerank(sequences, events, mapping, lambda rows: rows.join(values, ["video_id", "keyframe_number", "event"]), pairs=15).orderBy("rank").collect()

    low, high = min(s for _, _, s, _ in seqs), max(s for _, _, s, _ in seqs)
    clip = {v: (s - low) / (high - low) for _, v, s, _ in seqs}
    mix = lambda x: 0.72 * sum(x) / 3 + 0.28 * min(x)
    score, path = {}, {v: p for _, v, _, p in seqs}
    centre = [v for _, v, _, _ in seqs[:5]]
    for v in frames:
        score[v] = 0.85 * mix([value[v, k, e] for e, k in enumerate(path[v])]) + 0.15 * clip[v] if v in centre else 0.35 * clip[v]
    for v in sorted(centre, key=lambda v: -score[v])[:3]:
        choices = [[k for k in range(frames[v]) if abs(k - c) <= 2 + (e == 2)] for e, c in enumerate(path[v])]
        path[v] = max((p for p in itertools.product(*choices) if p[0] < p[1] < p[2]), key=lambda p: sum(value[v, k, e] for e, k in enumerate(p)))
        score[v] = 0.88 * mix([value[v, k, e] for e, k in enumerate(path[v])]) + 0.12 * clip[v]
    want = [(v, round(score[v], 9), [k * 10 for k in path[v]]) for v in sorted(frames, key=lambda v: -score[v])]
    assert [(r.video_id, round(r.score, 9), list(r.keyframes)) for r in got] == want


def test_runs_are_summed_up(spark):
    df = spark.createDataFrame([("q", 1.0), ("q", 3.0)], "query string, seconds double")
    assert tuple(evaluation.run_summary(df).first()) == ("q", 2.0, 1.0)
    stats = preprocess.index_statistics(spark.createDataFrame([], "schema int")).first()
    assert tuple(stats) == (0, 2, 0)
    t = spark.createDataFrame([("x", 0.5, 2), ("x", 0.4, 2), ("x", 1.0, 1), (None, 1.0, 2)], "t string, q double, s int")
    assert [r[0] for r in t.select(preprocess.trusted_text("t", "q", "s")).collect()] == ["x", "", "", ""]
    assert t.select(preprocess.record_quality(vector.F.col("q"), vector.F.lit(0.45))).first()[0] == 0.45
