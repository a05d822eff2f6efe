"""The reference's operators as queries, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import alignment, bm25, evaluation, fusion, language, models, preprocess, qa, refine, router, search, select, trake, vector
from ..sources import files, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(x: str) -> Column:
    return F.round(F.col(x), 6).alias(x)


FRAMES = "frames AS (SELECT 'src' || label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS feature_index, vec_id AS frame_id, embedding::DOUBLE[] AS e FROM embeddings)"
COS = "list_inner_product(f.e, q.e) / (greatest(sqrt(list_inner_product(f.e, f.e)), 1e-12) * greatest(sqrt(list_inner_product(q.e, q.e)), 1e-12))"


def qvecs(*ids: int) -> str:
    rows = " UNION ALL ".join(f"SELECT {k} AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = {i}" for k, i in enumerate(ids))
    return f"qv AS ({rows})"


SCORED = f"scored AS (SELECT q.query_id, f.video_id, f.feature_index, f.frame_id, {COS} AS score FROM frames f CROSS JOIN qv q)"


@query(f"WITH {FRAMES}, {qvecs(3)}, {SCORED} SELECT row_number() OVER (ORDER BY score DESC, video_id, frame_id)::INTEGER AS rank, video_id, frame_id, round(score, 6) AS score FROM scored QUALIFY rank <= 100")
def t4_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    s = vector.scored(tables.frames(spark, d), tables.query_vectors(spark, d, [3]))
    return vector.top_k(s, 100, F.desc("score"), F.col("video_id"), F.col("frame_id")).select("rank", "video_id", "frame_id", r6("score"))


@query(f"WITH {FRAMES}, {qvecs(3)}, {SCORED} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_id)::INTEGER AS rank, frame_id, round(score, 6) AS score FROM scored QUALIFY rank <= 30")
def w8_per_video_topn(spark: SparkSession, d: str) -> DataFrame:
    s = vector.scored(tables.frames(spark, d), tables.query_vectors(spark, d, [3]))
    return vector.top_per_group(s, 30, ["video_id"], F.desc("score"), F.col("frame_id")).select("video_id", "rank", "frame_id", r6("score"))


def greedy_sql(rows: str, gap: int, most: int) -> str:
    """`rows`: a query giving (g, f, s)."""
    return f"""r AS (SELECT g, f, s, row_number() OVER (PARTITION BY g ORDER BY s DESC, f) AS rn FROM ({rows})),
      k AS (SELECT g, 0::BIGINT AS rn, []::BIGINT[] AS kept FROM (SELECT DISTINCT g FROM r)
        UNION ALL SELECT k.g, r.rn, CASE WHEN len(k.kept) < {most} AND len(list_filter(k.kept, lambda x: abs(x - r.f) <= {gap})) = 0 THEN list_append(k.kept, r.f) ELSE k.kept END
        FROM k JOIN r ON r.g = k.g AND r.rn = k.rn + 1),
      kept AS (SELECT g, unnest(kept) AS f FROM (SELECT g, kept FROM k QUALIFY row_number() OVER (PARTITION BY g ORDER BY rn DESC) = 1))"""


@query(f"WITH RECURSIVE {greedy_sql('SELECT user_id AS g, event_id AS f, value AS s FROM events', 90, 4)} SELECT r.g AS user_id, r.f AS event_id, r.s AS value FROM r JOIN kept USING (g, f)")
def k5_greedy_gap(spark: SparkSession, d: str) -> DataFrame:
    return select.greedy_gap(tables.load(spark, d, "events"), ["user_id"], "event_id", "value", 90, 4)


TERMS = "list_filter(regexp_extract_all(replace(strip_accents(lower({t})), 'đ', 'd'), '[\\p{{L}}\\p{{N}}_]+'), lambda x: {keep})"
STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
NORM = "replace(strip_accents(lower({t})), 'đ', 'd')"
SQUEEZED = "trim(regexp_replace(" + NORM + ", '\\s+', ' ', 'g'))"
ALIAS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in X.ALIASES.items()) + "}"
BM25_PART = "ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))"


def ticker_sql(text: str) -> str:
    plain = SQUEEZED.format(t=text)
    hits = " + ".join(f"regexp_matches({plain}, '{p}')::INT" for p in preprocess.TICKER_PATTERNS)
    compact = f"regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"
    return f"CASE WHEN schema >= 2 THEN 1.0 WHEN contains({compact}, 'canhbao') AND contains({compact}, 'satlo') AND regexp_matches({compact}, 'nguyi?hiem') THEN 1.0 WHEN {hits} >= 3 THEN 0.05 WHEN {hits} >= 2 THEN 0.12 ELSE 1.0 END::DOUBLE"


OCR = "ocr AS (SELECT source AS video_id, doc_id AS doc, text, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS schema FROM documents)"


@query(f"WITH {OCR} SELECT doc, {ticker_sql('text')} AS quality FROM ocr")
def f9_legacy_quality(spark: SparkSession, d: str) -> DataFrame:
    return tables.records(spark, d).select("doc", preprocess.legacy_quality("text", "schema").alias("quality"))


OCR_SQL = f"""
  t AS (SELECT doc, {ticker_sql("text")} AS quality, {NORM.format(t="text")} AS norm, {TERMS.format(t="text", keep=f"length(x) > 1 AND NOT list_contains({STOP}, x)")} AS terms FROM ocr),
  p AS (SELECT doc, term, count(*) AS f FROM (SELECT doc, unnest(terms) AS term FROM t) GROUP BY ALL),
  dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  st AS (SELECT count(*) AS n, greatest(avg(len(terms)), 1.0) AS avg_len FROM t),
  q AS (SELECT query_id, trim({NORM.format(t="query")}, ' ' || chr(9) || chr(10) || chr(13)) AS qnorm, {TERMS.format(t="query", keep=f"length(x) > 1 AND NOT list_contains({STOP}, x)")} AS qterms FROM queries),
  g AS (SELECT query_id, g, unnest(list_concat([term], coalesce(({ALIAS})[term], []))) AS term FROM (SELECT query_id, unnest(qterms) AS term, generate_subscripts(qterms, 1) AS g FROM q)),
  w AS (SELECT query_id, term, count(*) AS qf FROM g GROUP BY ALL),
  raw AS (SELECT query_id, p.doc, sum({BM25_PART} * least(qf, f)) AS raw FROM w JOIN p USING (term) JOIN dfs USING (term) JOIN (SELECT doc, len(terms) AS len FROM t) l ON l.doc = p.doc CROSS JOIN st GROUP BY ALL),
  m AS (SELECT query_id, doc, count(DISTINCT g) AS matched FROM g JOIN p USING (term) GROUP BY ALL),
  s AS (SELECT query_id, doc, matched, raw * (1 + 0.75 * matched / len(qterms)) * quality * CASE WHEN length(qnorm) >= 6 AND contains(flat, qnorm) THEN 2.0 WHEN length(compact) >= 6 AND contains(flat, compact) THEN 1.65 ELSE 1.0 END AS s
    FROM raw JOIN m USING (query_id, doc) JOIN (SELECT *, array_to_string(qterms, ' ') AS compact FROM q) USING (query_id) JOIN (SELECT doc, quality, norm AS flat FROM t WHERE quality >= 0.20) USING (doc)
    WHERE matched >= CASE WHEN len(qterms) <= 2 THEN 1 ELSE greatest(2, ceil(len(qterms) * 0.35)) END),
  found AS (SELECT query_id, doc, s / max(s) OVER (PARTITION BY query_id) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, matched DESC, doc DESC)::INTEGER AS rank FROM s QUALIFY rank <= 200)"""


@query(f"WITH {OCR}, queries AS (SELECT item_id AS query_id, text AS query FROM benchmark), {OCR_SQL} SELECT query_id, doc, rank, round(score, 6) AS score FROM found")
def t1_ocr_bm25(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.records(spark, d).withColumn("quality", preprocess.legacy_quality("text", "schema"))
    queries = tables.load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return bm25.ocr_search(docs, queries).select("query_id", "doc", "rank", r6("score"))


META_QUERIES = ("green polished steel", "small brushed tin", "promo")


@query(f"""WITH t AS (SELECT p_partkey AS doc, {TERMS.format(t="p_name || ' ' || p_brand || ' ' || p_type", keep="true")} AS terms FROM part),
  queries(query_id, query) AS (VALUES {", ".join(f"({i}, '{q}')" for i, q in enumerate(META_QUERIES))}),
  p AS (SELECT doc, term, count(*) AS f FROM (SELECT doc, unnest(terms) AS term FROM t) GROUP BY ALL),
  dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term), st AS (SELECT count(*) AS n, greatest(avg(len(terms)), 1.0) AS avg_len FROM t),
  q AS (SELECT query_id, {TERMS.format(t="query", keep="length(x) > 1")} AS qterms FROM queries),
  w AS (SELECT query_id, term, least(count(*), 2) AS qf FROM (SELECT query_id, unnest(qterms) AS term FROM q) GROUP BY ALL),
  s AS (SELECT query_id, doc, sum({BM25_PART} * qf) * (1 + 0.45 * count(*) / any_value(nq)) AS s FROM w JOIN p USING (term) JOIN dfs USING (term) JOIN (SELECT doc, len(terms) AS len FROM t) USING (doc) JOIN (SELECT query_id, len(list_distinct(qterms)) AS nq FROM q) USING (query_id) CROSS JOIN st GROUP BY ALL)
  SELECT q.query_id, t.doc, round(CASE WHEN max(coalesce(s, 0)) OVER (PARTITION BY q.query_id) > 0 THEN coalesce(s, 0) / max(coalesce(s, 0)) OVER (PARTITION BY q.query_id) ELSE 0 END, 6)::DOUBLE AS score FROM q CROSS JOIN t LEFT JOIN s ON s.query_id = q.query_id AND s.doc = t.doc""")
def t2_metadata_bm25(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    queries = spark.createDataFrame(list(enumerate(META_QUERIES)), "query_id int, query string")
    return bm25.metadata_search(docs, queries).select("query_id", "doc", r6("score"))


EVENTS3 = (3, 17, 40)


def aligned(spark: SparkSession, d: str) -> DataFrame:
    s = vector.scored(tables.frames(spark, d), tables.query_vectors(spark, d, list(EVENTS3)))
    wide = s.groupBy("video_id", "feature_index", "frame_id").agg(*[F.max(F.when(F.col("query_id") == e, F.col("score"))).alias(f"s{e}") for e in range(3)])
    return alignment.ordered_alignment(wide, ["video_id"], "frame_id", ["s0", "s1", "s2"])


ALIGNED = f"""{FRAMES}, {qvecs(*EVENTS3)}, {SCORED},
  wide AS (SELECT video_id, frame_id, max(score) FILTER (query_id = 0) AS s0, max(score) FILTER (query_id = 1) AS s1, max(score) FILTER (query_id = 2) AS s2 FROM scored GROUP BY ALL),
  c0 AS (SELECT *, {{'v': s0, 'o': -frame_id, 'path': [frame_id]}} AS c FROM wide),
  c1 AS (SELECT *, CASE WHEN b IS NOT NULL THEN {{'v': b.v + s1, 'o': -frame_id, 'path': list_append(b.path, frame_id)}} END AS c1 FROM (SELECT *, max(c) OVER w AS b FROM c0 WINDOW w AS (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
  c2 AS (SELECT *, CASE WHEN b2 IS NOT NULL THEN {{'v': b2.v + s2, 'o': -frame_id, 'path': list_append(b2.path, frame_id)}} END AS c2 FROM (SELECT *, max(c1) OVER w AS b2 FROM c1 WINDOW w AS (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
  best AS (SELECT video_id, max(c2) AS b FROM c2 GROUP BY video_id HAVING b IS NOT NULL)"""


@query(f"WITH {ALIGNED} SELECT video_id, round(b.v, 6) AS total, array_to_string(b.path, ',') AS path FROM best")
def w4_ordered_alignment(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).select("video_id", r6("total"), F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query(f"WITH {ALIGNED} SELECT row_number() OVER (ORDER BY b.v DESC, video_id)::INTEGER AS rank, video_id, b.path[1] AS frame_id_1, b.path[2] AS frame_id_2, b.path[3] AS frame_id_3 FROM best QUALIFY rank <= 100")
def o2_trake_wide(spark: SparkSession, d: str) -> DataFrame:
    ranked = vector.top_k(aligned(spark, d), 100, F.desc("total"), F.col("video_id"))
    return files.wide_sequences(ranked, 3)


TYPES = ("view", "click", "purchase")


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type, value FROM events),
  x AS (SELECT user_id, i, CASE WHEN event_type = 'view' THEN value ELSE 0 END AS s0, CASE WHEN event_type = 'click' THEN value ELSE 0 END AS s1, CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS s2 FROM e),
  a AS (SELECT *, max(s0) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + s1 AS d1 FROM x),
  b AS (SELECT *, max(d1) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + s2 AS d2 FROM a)
  SELECT user_id, round(max(d2), 6) AS total FROM b GROUP BY user_id HAVING max(d2) IS NOT NULL""")
def w4_event_sequence(spark: SparkSession, d: str) -> DataFrame:
    e = tables.load(spark, d, "events")
    e = e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    e = e.select("user_id", "i", *[F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0).alias(f"s{k}") for k, t in enumerate(TYPES)])
    return alignment.ordered_alignment(e, ["user_id"], "i", ["s0", "s1", "s2"]).select("user_id", r6("total"))


@query(f"""WITH {FRAMES}, {qvecs(*EVENTS3)}, {SCORED},
  c AS (SELECT query_id AS event, video_id, frame_id, score, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, frame_id) AS rn FROM scored QUALIFY rn <= 5),
  j AS (SELECT a.video_id, a.score + b.score + c.score AS total, a.frame_id AS f1, b.frame_id AS f2, c.frame_id AS f3 FROM c a JOIN c b ON a.video_id = b.video_id AND a.event = 0 AND b.event = 1 AND a.frame_id < b.frame_id JOIN c ON c.video_id = a.video_id AND c.event = 2 AND b.frame_id < c.frame_id)
  SELECT video_id, round(max(total), 6) AS total FROM j GROUP BY video_id""")
def w5_candidate_alignment(spark: SparkSession, d: str) -> DataFrame:
    s = vector.scored(tables.frames(spark, d), tables.query_vectors(spark, d, list(EVENTS3)))
    c = vector.top_per_group(s, 5, ["query_id", "video_id"], F.desc("score"), F.col("frame_id")).withColumnRenamed("query_id", "event")
    return alignment.candidate_alignment(c, ["video_id"], 3).select("video_id", r6("total"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    """Frames numbered by place in their video, as decoded frames are."""
    return tables.frames(spark, d).select("video_id", F.col("feature_index").alias("frame_id"), "embedding")


@query(f"""WITH f AS (SELECT 'src' || label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_id, embedding::DOUBLE[] AS e FROM embeddings), {qvecs(3)},
  s AS (SELECT f.video_id, f.frame_id, {COS} AS score FROM f CROSS JOIN qv q),
  a AS (SELECT * FROM s WHERE frame_id % 4 = 0 ORDER BY score DESC, video_id, frame_id LIMIT 20),
  b AS (SELECT s.* FROM s WHERE frame_id % 2 = 0 AND EXISTS (SELECT 1 FROM a WHERE a.video_id = s.video_id AND s.frame_id BETWEEN a.frame_id - 4 AND a.frame_id + 4) ORDER BY score DESC, video_id, frame_id LIMIT 20),
  c AS (SELECT s.* FROM s WHERE EXISTS (SELECT 1 FROM b WHERE b.video_id = s.video_id AND s.frame_id BETWEEN b.frame_id - 2 AND b.frame_id + 2) ORDER BY score DESC, video_id, frame_id LIMIT 20)
  SELECT video_id, frame_id, round(score, 6) AS score FROM c""")
def j7_modulo_refine(spark: SparkSession, d: str) -> DataFrame:
    """Coarse frames, then twice finer around the best."""
    steps, order = refine.modulo_schedule("4,2,1"), (F.desc("score"), F.col("video_id"), F.col("frame_id"))
    s = vector.scored(positions(spark, d), tables.query_vectors(spark, d, [3])).select("video_id", "frame_id", "score")
    best = s.filter(F.col("frame_id") % steps[0] == 0).orderBy(*order).limit(20)
    for previous, step in zip(steps, steps[1:], strict=False):
        best = refine.refine(s, best, previous, step).orderBy(*order).limit(20)
    return best.select("video_id", "frame_id", r6("score"))


TRUTH = "truth AS (SELECT user_id AS query_id, 'v' || (user_id % 7) AS video_id, event_id - 50 AS s, event_id + 50 AS e FROM events WHERE event_type = 'purchase')"
PREDS = "preds AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rank, 'v' || (user_id % 7) AS video_id, event_id || '.0' AS frame_id FROM events)"
HITS = f"{TRUTH}, {PREDS}, hits AS (SELECT query_id, rank, video_id, frame_id, EXISTS (SELECT 1 FROM truth t WHERE t.query_id = p.query_id AND t.video_id = p.video_id AND try_cast(try_cast(p.frame_id AS DOUBLE) AS BIGINT) BETWEEN t.s AND t.e)::INT::DOUBLE AS score FROM preds p WHERE rank <= 100)"


def judged(spark: SparkSession, d: str) -> DataFrame:
    e = tables.load(spark, d, "events").withColumn("video_id", F.concat(F.lit("v"), (F.col("user_id") % 7).cast("string")))
    truth = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("query_id"), "video_id", (F.col("event_id") - 50).alias("start"), (F.col("event_id") + 50).alias("end"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    preds = e.select(F.col("user_id").alias("query_id"), rank.alias("rank"), "video_id", F.concat(F.col("event_id").cast("string"), F.lit(".0")).alias("frame_id"))
    return evaluation.interval_scores(preds, truth)


@query(f"WITH {HITS} SELECT * FROM hits")
def j9_interval_eval(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d)


@query(f"WITH {HITS}, r AS (SELECT query_id, {', '.join(f'coalesce(max(score) FILTER (rank <= {k}), 0.0) AS r{k}' for k in evaluation.CUTOFFS)} FROM hits GROUP BY query_id) SELECT query_id, r1, r5, r20, r50, r100, (r1 + r5 + r20 + r50 + r100) / 5 AS final_score FROM r")
def a15_final_score(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.recall_at(judged(spark, d))


@query("WITH d AS (SELECT l_orderkey AS frame_id, l_returnflag AS label, l_discount * 10 AS confidence FROM lineitem WHERE l_discount * 10 >= 0.20) SELECT frame_id, coalesce(max(confidence) FILTER (label = 'A'), 0.0) AS \"A\", coalesce(max(confidence) FILTER (label = 'N'), 0.0) AS \"N\", coalesce(max(confidence) FILTER (label = 'R'), 0.0) AS \"R\" FROM d GROUP BY frame_id")
def a9_object_matrix(spark: SparkSession, d: str) -> DataFrame:
    det = tables.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_returnflag").alias("label"), (F.col("l_discount") * 10).alias("confidence"))
    return preprocess.object_matrix(det, ["A", "N", "R"])


@query("WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM events) SELECT user_id, event_id, frame FROM e WHERE frame = 0 OR floor((frame + 1e-6) / 15.0) > floor((frame - 1 + 1e-6) / 15.0)")
def f3_temporal_sampler(spark: SparkSession, d: str) -> DataFrame:
    e = tables.load(spark, d, "events").select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("frame"))
    return e.filter(preprocess.sampled_frame("frame", 30.0, 2.0))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 1280 AS x0, l_suppkey % 720 AS y0, (l_quantity * 8)::DOUBLE AS w, (l_tax * 500)::DOUBLE AS h, l_linenumber AS chars FROM lineitem),
  r AS (SELECT *, (x0 + x0 + w) / 2 / 1280 AS cx, (y0 + y0 + h) / 2 / 720 AS cy, w / 1280 AS rw, h / 720 AS rh FROM b)
  SELECT l_orderkey, l_linenumber, (cy >= 0.82 AND rh <= 0.14 AND (rw >= 0.10 OR chars >= 6)) OR (cy <= 0.20 AND (cx <= 0.22 OR cx >= 0.78) AND rh <= 0.12 AND rw <= 0.32) AS overlay FROM r""")
def f8_overlay_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = tables.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1280).alias("x0"), (F.col("l_suppkey") % 720).alias("y0"), (F.col("l_quantity") * 8).alias("w"), (F.col("l_tax") * 500).alias("h"))
    box = preprocess.overlay_box(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"), 1280, 720, F.col("l_linenumber"))
    return b.select("l_orderkey", "l_linenumber", box.alias("overlay"))


@query("SELECT source AS video_id, row_number() OVER (ORDER BY source)::INTEGER AS ordinal, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) QUALIFY ordinal BETWEEN 2 AND 7")
def k9_video_window(spark: SparkSession, d: str) -> DataFrame:
    videos = tables.load(spark, d, "documents").groupBy(F.col("source").alias("video_id")).agg(F.count("*").alias("n"))
    return select.video_window(videos, 2, 7).select("video_id", "ordinal", "n")


@query(f"WITH {FRAMES}, s AS (SELECT *, frame_id - lag(frame_id) OVER (PARTITION BY video_id ORDER BY feature_index) AS step FROM frames), v AS (SELECT video_id, count(*) AS n_frames, min(len(e))::INTEGER AS min_dim, max(len(e))::INTEGER AS max_dim, coalesce(bool_and(step > 0), true) AS rising, coalesce(bool_and(step = 1), true) AND min(frame_id) = 0 AS continuous, count(*) FILTER (frame_id % 4 = 0) AS n_coarse FROM s GROUP BY video_id) SELECT *, rising AND min_dim = max_dim AND n_coarse > 0 AS sound FROM v")
def w6_shard_validation(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.valid_shards(tables.frames(spark, d))


@query("SELECT source AS video_id, count(*) AS n_records, count(*) FILTER (l.doc_id IS NOT NULL) AS n_labelled, count(*) FILTER (quality = 1) AS n_good, sum(n_chars)::BIGINT AS n_chars FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source")
def a11_manifest(spark: SparkSession, d: str) -> DataFrame:
    j = tables.load(spark, d, "documents").join(tables.load(spark, d, "labels").withColumn("_l", F.lit(True)), "doc_id", "left")
    return j.groupBy(F.col("source").alias("video_id")).agg(F.count("*").alias("n_records"), F.count_if("_l").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"), F.sum("n_chars").alias("n_chars"))


@query("SELECT p_partkey, array_to_string(list_filter([p_name, p_type, p_brand], lambda x, i: list_position([p_name, p_type, p_brand], x) = i), '|') AS labels FROM part")
def s6_json_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels out of nested JSON: any depth, keys in either case, lists below their key, each label once."""
    p = tables.load(spark, d, "part")
    text = F.format_string('{"Objects":[{"LABEL":" %s ","score":"high"},{"name":["%s"," ",{"class":"%s"}]}],"note":"skipped","category":{"deep":"no","display_name":"%s"}}', "p_name", "p_type", "p_brand", "p_name")
    return p.select("p_partkey", F.array_join(files.object_labels(text), "|").alias("labels"))


@query(f"WITH n AS (SELECT conv_id, turn, {SQUEEZED.format(t='text')} AS t FROM conversations) SELECT conv_id, turn, regexp_replace(t, '^mau ', '') AS answer FROM n")
def x21_answer_match(spark: SparkSession, d: str) -> DataFrame:
    return tables.load(spark, d, "conversations").select("conv_id", "turn", evaluation.normalize_answer("text").alias("answer"))


@query(f"""WITH {FRAMES}, {qvecs(*EVENTS3)}, {SCORED},
  p AS (SELECT query_id, video_id, frame_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, frame_id) AS rn FROM scored QUALIFY rn <= 200)
  SELECT video_id, frame_id, round(max(score), 6) AS score, string_agg('q' || query_id, ',' ORDER BY query_id) AS sources FROM p GROUP BY video_id, frame_id""")
def j5_merge_sources(spark: SparkSession, d: str) -> DataFrame:
    """Recall lists of several sources, united and merged by key: best score, sources in their order."""
    s = vector.scored(tables.frames(spark, d), tables.query_vectors(spark, d, list(EVENTS3)))
    lists = vector.top_per_group(s, 200, ["query_id"], F.desc("score"), F.col("video_id"), F.col("frame_id"))
    names = F.transform(F.array_sort(F.collect_list("query_id")), lambda q: F.concat(F.lit("q"), q.cast("string")))
    return lists.groupBy("video_id", "frame_id").agg(F.round(F.max("score"), 6).alias("score"), F.array_join(F.array_distinct(names), ",").alias("sources"))


QA = r"^(.*?)(?:câu\s*hỏi|question)\s*[:\-]\s*(.+)$"


@query(f"""WITH c AS (SELECT conv_id, turn, trim(CASE WHEN turn % 2 = 0 THEN coalesce(text, '') || chr(10) || 'Question: how many?' WHEN conv_id % 3 = 0 THEN ' Question: why' ELSE coalesce(text, '') END, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations),
  p AS (SELECT conv_id, turn, t, regexp_matches(t, '(?is){QA}') AS m, trim(CASE WHEN m THEN regexp_extract(t, '(?is){QA}', 1) ELSE t END, CASE WHEN m THEN ' .:-' || chr(10) ELSE '' END) AS event, trim(CASE WHEN m THEN regexp_extract(t, '(?is){QA}', 2) ELSE t END, ' ' || chr(9) || chr(10) || chr(13)) AS question FROM c)
  SELECT conv_id, turn, CASE WHEN m THEN event ELSE t END AS event, question, CASE WHEN t = '' THEN 'empty' WHEN m AND (event = '' OR question = '') THEN 'half' ELSE '' END AS problem FROM p""")
def x18_qa_split(spark: SparkSession, d: str) -> DataFrame:
    """An event and its question, split at the marker; without one both are the whole text."""
    c, text = tables.load(spark, d, "conversations"), F.coalesce("text", F.lit(""))
    t = F.when(F.col("turn") % 2 == 0, F.concat(text, F.lit("\nQuestion: how many?"))).when(F.col("conv_id") % 3 == 0, F.lit(" Question: why")).otherwise(text)
    return c.select("conv_id", "turn", t.alias("t")).select("conv_id", "turn", qa.split("t").alias("p")).select("conv_id", "turn", "p.*")


@query("""WITH p AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_type AS answer, value FROM events QUALIFY rank <= 8),
  s AS (SELECT query_id, answer, sum(value / (1 + 0.10 * greatest(rank - 1, 0))) AS support, min(rank) AS first FROM p GROUP BY ALL)
  SELECT query_id, answer, round(support, 6) AS support FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(support, 9) DESC, first) = 1""")
def a7_answer_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Of each query's first eight answers the one with most confidence, discounted by rank; ties go to the earlier."""
    e = tables.load(spark, d, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    p = e.select(F.col("user_id").alias("query_id"), rank.alias("rank"), F.col("event_type").alias("answer"), F.col("value").alias("confidence"), F.lit("general").alias("kind")).filter("rank <= 8")
    return qa.consensus(p).select("query_id", "answer", r6("support"))


POOL = "SELECT user_id AS query_id, 'v' || (event_id % 5) AS video_id, event_id AS key, event_id AS frame_id, CASE WHEN event_id % 3 <> 0 THEN row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) END AS visual_rank, CASE WHEN event_id % 4 = 0 THEN row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) END AS ocr_rank, ((event_id * 7) % 11)::DOUBLE AS metadata_score, ((event_id * 3) % 17)::DOUBLE AS score FROM events"


@query(f"""WITH RECURSIVE c AS ({POOL}),
  o AS (SELECT query_id, video_id, key, frame_id, p.phase, CASE p.phase WHEN 0 THEN visual_rank WHEN 1 THEN ocr_rank WHEN 2 THEN -metadata_score ELSE -score END AS turn FROM c CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS phase) p WHERE turn IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phase, turn, video_id, key) AS rn FROM o),
  k AS (SELECT query_id, 0::BIGINT AS rn, []::STRUCT(phase INTEGER, video_id VARCHAR, key BIGINT, frame_id BIGINT)[] AS kept FROM (SELECT DISTINCT query_id FROM r)
    UNION ALL SELECT k.query_id, r.rn, CASE WHEN len(k.kept) < 12 AND len(list_filter(k.kept, lambda x: x.video_id = r.video_id AND x.key = r.key)) = 0 AND len(list_filter(k.kept, lambda x: x.phase = r.phase)) < [7, 4, 1, 12, 12][r.phase + 1]
      AND (r.phase = 4 OR (len(list_filter(k.kept, lambda x: x.video_id = r.video_id)) < 3 AND len(list_filter(k.kept, lambda x: x.video_id = r.video_id AND abs(x.frame_id - r.frame_id) <= 30)) = 0))
      THEN list_append(k.kept, {{'phase': r.phase, 'video_id': r.video_id, 'key': r.key, 'frame_id': r.frame_id}}) ELSE k.kept END
    FROM k JOIN r ON r.query_id = k.query_id AND r.rn = k.rn + 1),
  f AS (SELECT query_id, kept FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rn DESC) = 1)
  SELECT query_id, place::INTEGER AS place, x.phase AS phase, x.video_id AS video_id, x.key AS key, x.frame_id AS frame_id FROM (SELECT query_id, unnest(kept) AS x, generate_subscripts(kept, 1) AS place FROM f)""")
def k6_quota_pool(spark: SparkSession, d: str) -> DataFrame:
    """Each query's reranking pool, shared out over its sources."""
    e = tables.load(spark, d, "events")
    place = lambda *order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    c = e.select(
        F.col("user_id").alias("query_id"), F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string")).alias("video_id"), F.col("event_id").alias("key"), F.col("event_id").alias("frame_id"),
        F.when(F.col("event_id") % 3 != 0, place(F.desc("value"), "event_id")).alias("visual_rank"), F.when(F.col("event_id") % 4 == 0, place("value", "event_id")).alias("ocr_rank"),
        ((F.col("event_id") * 7) % 11).cast("double").alias("metadata_score"), ((F.col("event_id") * 3) % 17).cast("double").alias("score"),
    )
    c = vector.top_per_group(c, 600, ["query_id"], F.desc("score"), F.col("key")).drop("rank")  # what recall may return
    return select.quota_pool(c, ["query_id"], 12, select.shares(0.55, 0.30, 0.10, 0.0, 12), 3, 30)


@query("""WITH p AS (SELECT user_id AS query_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 32 AS pooled, (event_id % 101) / 100.0::DOUBLE AS j, (event_id % 53) / 52.0::DOUBLE AS v, (event_id % 29) / 28.0::DOUBLE AS s FROM events),
  r AS (SELECT query_id, event_id, pooled, CASE WHEN NOT pooled THEN 0.9::DOUBLE * s WHEN query_id % 2 = 0 THEN 0.72 * j + 0.28 * s ELSE 0.42 * j + 0.58 * (0.70 * v + 0.30 * s) END AS score FROM p)
  SELECT query_id, event_id, round(CASE WHEN pooled THEN score ELSE least(score, min(score) FILTER (pooled) OVER (PARTITION BY query_id) - 0.001) END, 6) AS score FROM r""")
def r6_rerank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Reranked scores of the pool; the rest stays below it."""
    e = tables.load(spark, d, "events").withColumnRenamed("user_id", "query_id")
    part = lambda n: (F.col("event_id") % n) / float(n - 1)
    pooled = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "event_id")) <= 32
    e = e.select("query_id", "event_id", pooled.alias("pooled"), fusion.rerank_score(part(101), part(53), part(29), F.col("query_id") % 2 == 0).alias("r"), (0.9 * part(29)).alias("s"))
    e = e.select("query_id", "event_id", "pooled", F.when(F.col("pooled"), F.col("r")).otherwise(F.col("s")).alias("score"))
    return fusion.cap_outside(e, ["query_id"], "pooled", "score").select("query_id", "event_id", r6("score"))


@query("""WITH s AS (SELECT user_id AS query_id, avg(value) AS mean, min(value) AS least, max(value) AS clip FROM events GROUP BY user_id),
  n AS (SELECT query_id, mean, least, CASE WHEN max(clip) OVER () - min(clip) OVER () < 1e-9 THEN 0.5 ELSE (clip - min(clip) OVER ()) / (max(clip) OVER () - min(clip) OVER ()) END AS c FROM s)
  SELECT query_id, round(CASE query_id % 3 WHEN 0 THEN 0.35 * c WHEN 1 THEN 0.85 * (0.72 * mean + 0.28 * least) + 0.15 * c ELSE 0.88 * (0.72 * mean + 0.28 * least) + 0.12 * c END, 6) AS score FROM n""")
def r7_sequence_rerank(spark: SparkSession, d: str) -> DataFrame:
    s = tables.load(spark, d, "events").groupBy(F.col("user_id").alias("query_id")).agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("clip"))
    kind = F.col("query_id") % 3
    s = vector.min_max_of_all(s, "clip", "c").withColumn("mean", F.when(kind != 0, F.col("mean")))
    return s.select("query_id", F.round(fusion.sequence_rerank(F.col("mean"), F.col("least"), F.col("c"), kind == 2), 6).alias("score"))


@query("""WITH t AS (SELECT user_id AS query_id, list(event_id ORDER BY event_id) AS ids FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3) GROUP BY user_id),
  p AS (SELECT user_id AS query_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rank, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE 'v' END AS video_id FROM events QUALIFY rank <= 100)
  SELECT query_id, rank, video_id, round(CASE WHEN video_id = 'v' THEN ((event_id BETWEEN ids[1] - 2000 AND ids[1] + 2000)::INT + coalesce((event_id + 1000 BETWEEN ids[2] - 2000 AND ids[2] + 2000)::INT, 0)) / len(ids)::DOUBLE ELSE 0 END, 6) AS score FROM p JOIN t USING (query_id)""")
def j10_trake_eval(spark: SparkSession, d: str) -> DataFrame:
    """Sequences against one interval an event; the third frame cannot be read and misses."""
    e = tables.load(spark, d, "events").withColumnRenamed("user_id", "query_id")
    first = vector.top_per_group(e, 3, ["query_id"], F.col("event_id"))
    around = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: F.struct((x - 2000).alias("start"), (x + 2000).alias("end")))
    truth = first.groupBy("query_id").agg(around.alias("intervals")).withColumn("video_id", F.lit("v"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "event_id"))
    frames = F.array(F.col("event_id").cast("string"), F.concat((F.col("event_id") + 1000).cast("string"), F.lit(".0")), F.lit("none"))
    p = e.select("query_id", rank.alias("rank"), F.when(F.col("event_id") % 5 == 0, "x").otherwise("v").alias("video_id"), frames.alias("frames"))
    return evaluation.event_scores(p, truth).select("query_id", "rank", "video_id", r6("score"))


@query("")
def m5_trake_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    """Event sequences from coarse to fine frames; a test holds it against brute force."""
    s = vector.scored(positions(spark, d), tables.query_vectors(spark, d, list(EVENTS3)))
    wide = s.groupBy("video_id", "frame_id").agg(*[F.max(F.when(F.col("query_id") == e, F.col("score"))).alias(f"s{e}") for e in range(3)])
    found = refine.refine_sequences(wide, 3, refine.modulo_schedule("4,2,1"), 5)
    return found.select("rank", "video_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), r6("score"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Search texts: turns, some with connectors, signs and quotations."""
    c = tables.load(spark, d, "conversations")
    kind = F.col("conv_id") % 4
    t = F.when(kind == 0, F.concat("text", F.lit(" a yellow sign with the text STOP HERE NOW; người mặc áo, what color"))).when(kind == 1, F.concat(F.lit("Biển màu vàng. chương trình nào? cảnh báo "), F.col("text"))).when(kind == 2, F.concat(F.lit("walking scene; \"Exit\" says "), F.col("text")))
    return c.select("conv_id", "turn", t.otherwise(F.col("text")).alias("q"))


def cue_sql(cues: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(n, '{c}')::INT" for c in cues) + ")"


SIGN = "(contains(n, 'bien') AND (contains(n, 'mau') OR contains(n, 'yellow')))"
ASKED = """asked AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN text || ' a yellow sign with the text STOP HERE NOW; người mặc áo, what color' WHEN 1 THEN 'Biển màu vàng. chương trình nào? cảnh báo ' || text WHEN 2 THEN 'walking scene; "Exit" says ' || text ELSE text END AS q FROM conversations)"""
CLAUSES = f"""{ASKED}, sent AS (SELECT conv_id, turn, i, list_transform(string_split(regexp_replace(sentence, '(?i){router.CONNECTOR}', chr(1), 'g'), chr(1)), lambda p: trim(p, ' ,:-—–')) AS parts
    FROM (SELECT conv_id, turn, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM (SELECT conv_id, turn, regexp_split_to_array(trim(regexp_replace(q, '\\s+', ' ', 'g')), '[.!?;\\n]+') AS s FROM asked))),
  cl AS (SELECT conv_id, turn, i, j, part AS text, CASE WHEN n > 1 AND j = n THEN 'ocr' ELSE '' END AS role FROM (SELECT conv_id, turn, i, unnest(parts) AS part, generate_subscripts(parts, 1) AS j, len(parts) AS n FROM sent) WHERE part <> ''),
  clauses AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, j) - 1)::INTEGER AS place, text, role FROM cl)"""
LEXICAL = {
    m: f"(({base} + least({most}, {worth} * {cue_sql(cues)}))"
    + {"visual": f" + CASE WHEN {SIGN} THEN 1.0 ELSE 0.0 END)", "ocr": f" * CASE WHEN {SIGN} THEN 0.55 ELSE 1.0 END + CASE WHEN role = 'ocr' THEN 2.4 ELSE 0.0 END)"}.get(m, ")")
    for m, (base, cues, worth, most) in router.EVIDENCE.items()
}
TOTAL = " + ".join(f"greatest(0.02, {m}::DOUBLE)" for m in router.MODALITIES)


def normal_sql(source: str, kept: str, damp: str = "") -> str:
    return f"SELECT {kept}, {', '.join(f'greatest(0.02, {m}::DOUBLE) / ({TOTAL})' + (damp if m != 'ocr' else '') + f' AS {m}' for m in router.MODALITIES)} FROM {source}"


SCORED_CLAUSES = f"""{CLAUSES}, folded AS (SELECT *, {SQUEEZED.format(t="text")} AS n, greatest(1, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS mass FROM clauses),
  lex AS (SELECT *, {", ".join(f"{LEXICAL[m]} AS {m}" for m in router.MODALITIES)} FROM folded),
  damped AS ({normal_sql("lex", "conv_id, turn, place, text, role, n, mass", " * CASE WHEN role = 'ocr' THEN 0.08 ELSE 1.0 END")}),
  sc AS ({normal_sql("damped", "conv_id, turn, place, text, role, n, mass")})"""


@query(f"WITH {CLAUSES} SELECT * FROM clauses")
def x8_query_clauses(spark: SparkSession, d: str) -> DataFrame:
    c = asked(spark, d).select("conv_id", "turn", F.posexplode(router.clauses("q")).alias("place", "c"))
    return c.select("conv_id", "turn", "place", "c.text", "c.role")


@query(f"""WITH {SCORED_CLAUSES}, sums AS (SELECT conv_id, turn, {", ".join(f"sum(mass * {m}) / sum(mass) AS {m}" for m in router.MODALITIES)}, string_agg(CASE WHEN role <> '' THEN role WHEN {SIGN} THEN 'visual' WHEN visual = greatest(visual, ocr, metadata, object) THEN 'visual' WHEN ocr = greatest(visual, ocr, metadata, object) THEN 'ocr' WHEN metadata >= object THEN 'metadata' ELSE 'object' END, ',' ORDER BY place) AS dominant FROM sc GROUP BY ALL)
  SELECT conv_id, turn, dominant, {", ".join(f"round({m}, 6) AS {m}" for m in router.MODALITIES)} FROM ({normal_sql("sums", "conv_id, turn, dominant")})""")
def x9_clause_weights(spark: SparkSession, d: str) -> DataFrame:
    """What each source is worth to a query, and its clauses' leading sources."""
    c = asked(spark, d).withColumn("c", router.clauses("q")).withColumn("s", router.scored_clauses("c"))
    c = c.select("conv_id", "turn", F.array_join(F.transform("s", lambda x: x.dominant), ",").alias("dominant"), router.weights("s").alias("w")).filter("w IS NOT NULL")
    return c.select("conv_id", "turn", "dominant", *[F.round(f"w.{m}", 6).alias(m) for m in router.MODALITIES])


def chosen_sql(m: str) -> str:
    warning = " OR ".join(f"contains(n, '{w}')" for w in router.WARNING_CUES)
    rest = f"{m} >= 0.20 AND {m} >= greatest(visual, ocr, metadata, object) - 0.12"
    return f"coalesce(string_agg(text, ' ' ORDER BY place) FILTER (CASE WHEN role <> '' THEN role = '{m}' WHEN {SIGN} THEN {m == 'visual'} WHEN {m == 'ocr'} AND ({warning}) THEN true ELSE {rest} END), '') AS {m}"


@query(f"WITH {SCORED_CLAUSES}, once AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY conv_id, turn, text, role ORDER BY place) = 1) SELECT conv_id, turn, {', '.join(map(chosen_sql, router.MODALITIES))} FROM once GROUP BY conv_id, turn")
def x14_source_queries(spark: SparkSession, d: str) -> DataFrame:
    """The part of each query that goes to each source."""
    c = asked(spark, d).withColumn("c", router.clauses("q")).filter(F.size("c") > 0).withColumn("s", router.scored_clauses("c"))
    return c.select("conv_id", "turn", *[router.query_for("s", m).alias(m) for m in router.MODALITIES])


NOT_WORD = r"[^\p{L}\p{N}_]"  # the SQL engine's own word boundary knows ASCII letters only


@query(f"""WITH {ASKED}, f AS (SELECT *, {SQUEEZED.format(t="q")} AS n FROM asked) SELECT conv_id, turn, coalesce({cue_sql(router.OCR_CUES)} > 0 OR regexp_matches(q, '["“”''][^"“”'']{{3,}}["“”'']') OR regexp_matches(q, '(^|{NOT_WORD})[A-ZÀ-ỸĐ][A-ZÀ-ỸĐ\\s]{{4,}}([A-ZÀ-ỸĐ]({NOT_WORD}|$)|\\s[\\p{{L}}\\p{{N}}_])'), false) AS explicit FROM f""")
def x15_ocr_intent(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("conv_id", "turn", router.explicit_ocr("q").alias("explicit"))


@query(f"""WITH a AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM conversations),
  l AS (SELECT conv_id, turn, string_split(CASE conv_id % 3 WHEN 0 THEN 'Find it' || chr(10) || 'Event 2 — b ' || t || chr(10) || ' - Sự kiện 1: a ' || t WHEN 1 THEN 'intro' || chr(10) || '2) second' || chr(10) || '1. first ' || t ELSE '• x ' || t || chr(10) || '- y' END, chr(10)) AS lines FROM a),
  x AS (SELECT conv_id, turn, list_filter(lines, lambda s: regexp_matches(s, '(?i){router.EVENT_LINE}')) AS ev, list_filter(lines, lambda s: regexp_matches(s, '{router.NUMBERED_LINE}')) AS nu, lines FROM l)
  SELECT conv_id, turn, array_to_string(CASE WHEN len(ev) > 0 THEN list_transform(list_reverse(ev), lambda s: trim(regexp_extract(s, '(?i){router.EVENT_LINE}', 2), ' -—–:' || chr(9))) WHEN len(nu) > 0 THEN list_transform(list_reverse(nu), lambda s: trim(regexp_extract(s, '{router.NUMBERED_LINE}', 2), ' -—–:' || chr(9))) ELSE list_transform(lines, lambda s: trim(ltrim(s, '-*• '))) END, '|') AS events FROM x""")
def x7_event_parse(spark: SparkSession, d: str) -> DataFrame:
    """The ordered events of numbered, labelled and plain prompts."""
    c = tables.load(spark, d, "conversations").withColumn("t", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    labelled = F.concat(F.lit("Find it\nEvent 2 — b "), "t", F.lit("\n - Sự kiện 1: a "), "t")
    t = F.when(F.col("conv_id") % 3 == 0, labelled).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("intro\n2) second\n1. first "), "t")).otherwise(F.concat(F.lit("• x "), "t", F.lit("\n- y")))
    return c.select("conv_id", "turn", t.alias("p")).select("conv_id", "turn", F.array_join(router.events("p").events, "|").alias("events"))


@query(f"""WITH {OCR}, queries AS (SELECT item_id AS query_id, text AS query FROM benchmark), {OCR_SQL},
  pairs AS (SELECT query_id AS item_id, doc AS doc_id, b.text AS query, d.text AS text FROM found f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d ON d.doc_id = f.doc WHERE rank <= 32),
  words AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '')) AS qw, list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '\\s+')) AS tw FROM pairs)
  SELECT item_id, doc_id, round(len(list_intersect(qw, tw)) / len(qw)::DOUBLE, 6) AS score FROM words""")
def m9_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """The first 32 texts that search finds for every item through a pair scorer; here word overlap stands in for a model."""
    docs = tables.records(spark, d).withColumn("quality", preprocess.legacy_quality("text", "schema"))
    b = tables.load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = bm25.ocr_search(docs, b).filter("rank <= 32").select("query_id", "doc")
    pairs = hits.join(b, "query_id").join(docs.select("doc", "text"), "doc")
    return models.score_pairs(pairs, models.TokenOverlap).select(F.col("query_id").alias("item_id"), F.col("doc").alias("doc_id"), r6("score"))


# The engines over every benchmark item, with all four kinds of evidence.
WORK = """work AS (SELECT item_id AS query_id, 'walking scene says ' || b.text || '. what color object ' || o.p_name || '. video title ' || m.p_name || ' ' || m.p_brand AS query
    FROM benchmark b CROSS JOIN (SELECT count(*) AS n FROM part) JOIN part o ON o.p_partkey = (item_id * 3 + 1) % n JOIN part m ON m.p_partkey = item_id % 10)"""
ENGINE_TABLES = f"""{FRAMES}, mapping AS (SELECT video_id, feature_index, feature_index + 1 AS keyframe_number, frame_id FROM frames WHERE frame_id % 50 <> 49),
  objects AS (SELECT video_id, keyframe_number, [p_name, lower(p_type)] AS labels FROM mapping CROSS JOIN (SELECT count(*) AS n FROM part) JOIN part ON (frame_id * 3) % n = p_partkey WHERE frame_id % 7 <> 0),
  meta AS (SELECT 'src' || p_partkey AS video_id, p_name AS title, {TERMS.format(t="p_name || ' ' || '' || ' ' || p_brand || ' ' || p_type", keep="true")} AS terms FROM part WHERE p_partkey < 20)"""
GAP, MOST = 90, 4
OPTIONS = search.Options(top_k=50, min_gap=GAP, max_per_video=MOST)


def evidence_sql(pool: int) -> str:
    """From `searches` (sid, query, mw, qvec) to `rows`: mapped frames with visual and metadata scores."""
    return f"""visual AS (SELECT sid, f.video_id, f.feature_index, list_inner_product(f.e, q.e) / (greatest(sqrt(list_inner_product(f.e, f.e)), 1e-12) * greatest(sqrt(list_inner_product(q.e, q.e)), 1e-12)) AS visual FROM frames f CROSS JOIN searches q
      QUALIFY row_number() OVER (PARTITION BY sid ORDER BY round(visual, 9) DESC, f.video_id, f.feature_index) <= {pool}),
  mapped AS (SELECT * FROM visual JOIN mapping USING (video_id, feature_index)),
  mq AS (SELECT sid, {TERMS.format(t="query", keep="true")} AS tokens FROM searches),
  mt AS (SELECT sid, term, least(count(*), 2) AS qf FROM (SELECT sid, unnest(list_filter(tokens, lambda x: length(x) > 1)) AS term FROM mq) GROUP BY ALL),
  mp AS (SELECT video_id, term, count(*) AS f FROM (SELECT video_id, unnest(terms) AS term FROM meta) GROUP BY ALL),
  mdf AS (SELECT term, count(*) AS df FROM mp GROUP BY term), mst AS (SELECT count(*) AS n, greatest(avg(len(terms)), 1.0) AS avg_len FROM meta),
  ms AS (SELECT sid, video_id, sum({BM25_PART} * qf) * (1 + 0.45 * count(*) / any_value(nq)) AS s FROM mt JOIN mp USING (term) JOIN mdf USING (term) JOIN (SELECT video_id, len(terms) AS len FROM meta) USING (video_id) JOIN (SELECT sid, count(*) AS nq FROM mt GROUP BY sid) USING (sid) CROSS JOIN mst GROUP BY ALL),
  mv AS (SELECT a.sid, a.video_id, CASE WHEN max(coalesce(s, 0)) OVER (PARTITION BY a.sid) > 0 THEN coalesce(s, 0) / max(coalesce(s, 0)) OVER (PARTITION BY a.sid) ELSE 0 END AS metadata FROM (SELECT DISTINCT sid, video_id FROM mapped) a LEFT JOIN ms ON ms.sid = a.sid AND ms.video_id = a.video_id),
  rows AS (SELECT m.*, metadata, mw, tokens, coalesce(title, '') AS title FROM mapped m JOIN mv USING (sid, video_id) JOIN searches USING (sid) JOIN mq USING (sid) LEFT JOIN (SELECT video_id, title FROM meta) USING (video_id))"""


OBJECT_SQL = f"CASE WHEN labels IS NULL OR len(tokens) = 0 THEN 0 ELSE len(list_intersect(list_distinct(tokens), list_distinct({TERMS.format(t="array_to_string(labels, ' ')", keep='true')})))::DOUBLE / len(list_distinct(tokens)) END"
FEATURE_SQL = f"""placed AS (SELECT *, (1 - mw) * visual + mw * metadata AS base, row_number() OVER (PARTITION BY sid ORDER BY round((1 - mw) * visual + mw * metadata, 9) DESC, video_id, feature_index) AS place FROM rows),
  seen AS (SELECT p.*, CASE WHEN place <= 300 THEN {OBJECT_SQL} ELSE 0 END AS object, CASE WHEN place <= 300 AND labels IS NOT NULL THEN labels ELSE [] END AS found FROM placed p LEFT JOIN objects USING (video_id, keyframe_number)),
  scored AS (SELECT *, base + 0.03 * object AS score FROM seen)"""


def diverse_sql(source: str, key: str, name: str, k: int) -> str:
    """The rows of `source` that the greedy scan keeps by score, ranked, as `name`."""
    return f"""{name}_r AS (SELECT {key} AS q, video_id, frame_id, score, row_number() OVER (PARTITION BY {key}, video_id ORDER BY round(score, 9) DESC, frame_id) AS rn FROM {source}),
  {name}_k AS (SELECT q, video_id, 0::BIGINT AS rn, []::BIGINT[] AS kept FROM (SELECT DISTINCT q, video_id FROM {name}_r)
    UNION ALL SELECT k.q, k.video_id, r.rn, CASE WHEN len(k.kept) < {MOST} AND len(list_filter(k.kept, lambda x: abs(x - r.frame_id) <= {GAP})) = 0 THEN list_append(k.kept, r.frame_id) ELSE k.kept END FROM {name}_k k JOIN {name}_r r ON r.q = k.q AND r.video_id = k.video_id AND r.rn = k.rn + 1),
  {name}_f AS (SELECT q, video_id, unnest(kept) AS frame_id FROM (SELECT * FROM {name}_k QUALIFY row_number() OVER (PARTITION BY q, video_id ORDER BY rn DESC) = 1)),
  {name} AS (SELECT s.*, row_number() OVER (PARTITION BY s.{key} ORDER BY round(score, 9) DESC, s.video_id, s.frame_id)::INTEGER AS rank FROM {source} s JOIN {name}_f f ON f.q = s.{key} AND f.video_id = s.video_id AND f.frame_id = s.frame_id QUALIFY rank <= {k})"""


ONE_SOURCE = f"""{WORK}, {ENGINE_TABLES}, searches AS (SELECT query_id AS sid, query, 0.10::DOUBLE AS mw, embedding::DOUBLE[] AS e FROM work CROSS JOIN (SELECT count(*) AS n FROM embeddings) JOIN embeddings ON vec_id = (query_id * 7) % n), {evidence_sql(search.recall_pool(50))}"""
RANKED_SQL = "SELECT sid AS query_id, rank, video_id, keyframe_number, frame_id, title, array_to_string({labels}, ',') AS labels, round(metadata, 6) AS metadata, round(object, 6)::DOUBLE AS object, round(score, 6) AS score"


def one_source(spark: SparkSession, d: str) -> DataFrame:
    s = tables.stub_vectors(spark, d, tables.workload(spark, d).withColumn("place", F.lit(0)))
    return s.withColumn("metadata_weight", F.lit(0.10))


def engine_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tables.frames(spark, d), tables.mapping(spark, d), tables.metadata(spark, d), tables.objects(spark, d)


def shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "video_id", "keyframe_number", "frame_id", "title", F.array_join("labels", ",").alias("labels"), r6("metadata"), r6("object"), r6("score"))


@query(f"WITH RECURSIVE {ONE_SOURCE}, {FEATURE_SQL}, {diverse_sql('scored', 'sid', 'best', 50)} {RANKED_SQL.format(labels='found')} FROM best")
def m1_feature_search(spark: SparkSession, d: str) -> DataFrame:
    """Every item's search: recall, mapping, metadata, object bonus, then temporal diversity."""
    return shown(search.feature_search(one_source(spark, d), *engine_tables(spark, d), OPTIONS))


@query(f"""WITH RECURSIVE {ONE_SOURCE}, plain AS (SELECT *, visual AS score FROM rows), {diverse_sql("plain", "sid", "kept", 50)},
  bonus AS (SELECT k.* EXCLUDE (score, rank), {OBJECT_SQL} AS object, coalesce(labels, []) AS found, visual + 0.03 * {OBJECT_SQL} AS score FROM kept k LEFT JOIN objects USING (video_id, keyframe_number)),
  best AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY round(score, 9) DESC, video_id, frame_id)::INTEGER AS rank FROM bonus) {RANKED_SQL.format(labels="found")} FROM best""")
def m2_direct_search(spark: SparkSession, d: str) -> DataFrame:
    """The other engine's order: temporal diversity first, then the object bonus."""
    return shown(search.direct_search(one_source(spark, d), *engine_tables(spark, d), OPTIONS))


ROUTED = SCORED_CLAUSES.replace(ASKED, "asked AS (SELECT query_id AS conv_id, 0 AS turn, query AS q FROM work)")
SOURCES_SQL = f"""{WORK}, {ROUTED},
  sums AS (SELECT conv_id, turn, {", ".join(f"sum(mass * {m}) / sum(mass) AS {m}" for m in router.MODALITIES)} FROM sc GROUP BY ALL),
  wt AS ({normal_sql("sums", "conv_id")}),
  once AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY conv_id, turn, text, role ORDER BY place) = 1),
  texts AS (SELECT conv_id, {", ".join(map(chosen_sql, router.MODALITIES))} FROM once GROUP BY conv_id),
  listed AS (SELECT conv_id, unnest([{{'k': 0, 'm': 'visual', 't': trim(visual)}}, {{'k': 1, 'm': 'object', 't': trim(object)}}, {{'k': 2, 'm': 'metadata', 't': trim(metadata)}}], recursive := true) FROM texts),
  chosen AS (SELECT * FROM listed WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, t ORDER BY k) = 1),
  found_sources AS (SELECT * FROM chosen UNION ALL SELECT query_id, 0, 'visual', query FROM work WHERE query_id NOT IN (SELECT conv_id FROM chosen)),
  source_queries AS (SELECT f.conv_id AS query_id, m AS source, k AS place, t AS query, CASE WHEN m = 'metadata' THEN least(0.30, 0.025 + 0.32 * wt.metadata) ELSE 0.025 END::DOUBLE AS metadata_weight FROM found_sources f JOIN wt USING (conv_id))"""


@query(f"WITH {SOURCES_SQL} SELECT query_id, source, place, query, round(metadata_weight, 6) AS metadata_weight FROM source_queries")
def u1_source_queries(spark: SparkSession, d: str) -> DataFrame:
    """What every item asks of each source, each text once, and the weight of metadata there."""
    return search.source_queries(search.analysed(tables.workload(spark, d))).select("query_id", "source", "place", "query", r6("metadata_weight"))


PLACED_OCR = "ocr AS (SELECT source AS video_id, doc_id AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS keyframe_number, text, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS schema FROM documents)"
KIS_SQL = f"""{SOURCES_SQL}, {ENGINE_TABLES},
  searches AS (SELECT query_id * 3 + place AS sid, query, metadata_weight AS mw, embedding::DOUBLE[] AS e FROM source_queries CROSS JOIN (SELECT count(*) AS n FROM embeddings) JOIN embeddings ON vec_id = (query_id * 7 + place * 101) % n),
  {evidence_sql(search.recall_pool(50))}, {FEATURE_SQL}, {diverse_sql("scored", "sid", "best", 50)},
  merged AS (SELECT sid // 3 AS query_id, video_id, keyframe_number, any_value(frame_id) AS frame_id, coalesce(arg_min(title, sid % 3) FILTER (title <> ''), '') AS title, max(visual) AS visual, max(metadata) AS metadata, max(object) AS object, max(score) AS score FROM best GROUP BY ALL),
  {PLACED_OCR}, queries AS (SELECT conv_id AS query_id, trim(ocr) AS query FROM texts WHERE trim(ocr) <> ''), {OCR_SQL.replace("q AS (", "oq AS (").replace("FROM q)", "FROM oq)").replace("FROM q ", "FROM oq ").replace("g AS (", "og AS (").replace("FROM g)", "FROM og)").replace("FROM g ", "FROM og ").replace(" w AS (", " ow AS (").replace("FROM w ", "FROM ow ").replace(" found AS (", " ofound AS (").replace(" s AS (", " os AS (").replace("FROM s QUALIFY", "FROM os QUALIFY").replace(" t AS (", " ot AS (").replace("FROM t)", "FROM ot)").replace("FROM t ", "FROM ot ").replace(" m AS (", " om AS (").replace("JOIN m ", "JOIN om ")},
  text_hits AS (SELECT h.query_id, o.video_id, o.keyframe_number, mapping.frame_id, h.score * x.quality AS ocr, x.quality, CASE WHEN x.quality >= 0.50 AND o.schema >= 2 THEN o.text ELSE '' END AS ocr_text FROM ofound h JOIN ocr o USING (doc) JOIN (SELECT doc, quality FROM ot) x USING (doc) JOIN mapping ON mapping.video_id = o.video_id AND mapping.keyframe_number = o.keyframe_number),
  j AS (SELECT coalesce(c.query_id, o.query_id) AS query_id, coalesce(c.video_id, o.video_id) AS video_id, coalesce(c.keyframe_number, o.keyframe_number) AS keyframe_number, coalesce(c.frame_id, o.frame_id) AS frame_id, coalesce(title, '') AS title, coalesce(visual, 0) AS visual, coalesce(metadata, 0) AS metadata, coalesce(object, 0) AS object, coalesce(ocr, 0) AS ocr, coalesce(ocr_text, '') AS ocr_text,
    CASE WHEN c.query_id IS NULL THEN 0.55 * ocr WHEN ocr IS NULL THEN score ELSE greatest(score, 0.40 * visual + 0.45 * ocr + 0.10 * metadata) END AS retrieval
    FROM merged c FULL JOIN text_hits o ON c.query_id = o.query_id AND c.video_id = o.video_id AND c.keyframe_number = o.keyframe_number),
  n AS (SELECT *, min(retrieval) OVER p AS r0, max(retrieval) OVER p AS r1, min(visual) OVER p AS v0, max(visual) OVER p AS v1 FROM j WINDOW p AS (PARTITION BY query_id)),
  fused AS (SELECT n.*, 0.22 * CASE WHEN r1 - r0 < 1e-9 THEN 0.5 ELSE (retrieval - r0) / (r1 - r0) END + 0.78 * (wt.visual * CASE WHEN v1 - v0 < 1e-9 THEN 0.5 ELSE (n.visual - v0) / (v1 - v0) END + wt.ocr * least(greatest(n.ocr, 0), 1) + wt.metadata * least(greatest(n.metadata, 0), 1) + wt.object * least(greatest(n.object, 0), 1)) AS score FROM n JOIN wt ON wt.conv_id = n.query_id)"""


def item_tables(spark: SparkSession, d: str) -> tuple:
    records = tables.records(spark, d).withColumn("quality", preprocess.legacy_quality("text", "schema"))
    return tables.workload(spark, d), lambda s: tables.stub_vectors(spark, d, s), *engine_tables(spark, d), records, tables.places(spark, d), OPTIONS


@query(f"WITH RECURSIVE {KIS_SQL} SELECT query_id, video_id, keyframe_number, frame_id, title, round(retrieval, 6) AS retrieval, round(score, 6) AS score, sha256(ocr_text) AS ocr_sha256 FROM fused")
def r5_adaptive_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Every item's candidates from all sources, fused by its weights."""
    c = search.candidates(*item_tables(spark, d))
    return c.select("query_id", "video_id", "keyframe_number", "frame_id", "title", r6("retrieval"), r6("score"), F.sha2("ocr_text", 256).alias("ocr_sha256"))


@query(f"WITH RECURSIVE {KIS_SQL}, {diverse_sql('fused', 'query_id', 'answers', 50)} SELECT query_id, rank, video_id, frame_id, round(score, 6) AS score FROM answers")
def m7_kis_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Known-item search for every item: sources, merge, text, fusion, temporal diversity, rank."""
    return search.known_item_search(*item_tables(spark, d)).select("query_id", "rank", "video_id", "frame_id", r6("score"))


# Questions and answers.
KIND_TEXT = "CASE conv_id % 4 WHEN 0 THEN 'How many: ' WHEN 1 THEN 'What is he holding, ' WHEN 2 THEN 'MÀU gì? ' ELSE '' END || coalesce(text, '')"


def word_sql(phrases: str) -> str:
    return f"(?i)(^|{NOT_WORD})(?:{phrases})({NOT_WORD}|$)"


KIND_SQL = f"""CASE WHEN regexp_matches(q, '{word_sql("bao\\s*nhiêu|bao\\s*nhieu|how\\s*many|number\\s+of|count|số\\s*lượng|so\\s*luong|dem\\s*so")}') THEN 'count'
  WHEN regexp_matches(q, '{word_sql("cầm|cam|holding|hold|carrying|carry|nắm|nam")}') THEN 'holding' WHEN regexp_matches(q, '{word_sql("màu|mau|color|colour|mặc|mac|wearing|áo|ao")}') THEN 'appearance' ELSE 'general' END"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    c = tables.load(spark, d, "conversations")
    front = F.when(F.col("conv_id") % 4 == 0, "How many: ").when(F.col("conv_id") % 4 == 1, "What is he holding, ").when(F.col("conv_id") % 4 == 2, "MÀU gì? ").otherwise("")
    return c.select("conv_id", "turn", F.concat(front, F.coalesce("text", F.lit(""))).alias("q"))


@query(f"WITH a AS (SELECT conv_id, turn, {KIND_TEXT} AS q FROM conversations) SELECT conv_id, turn, {KIND_SQL} AS kind FROM a")
def x19_question_kind(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("conv_id", "turn", qa.question_kind("q").alias("kind"))


NUMBER_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in evaluation.NUMBERS.items()) + "}"
ANSWER_SQL = f"""CASE conv_id % 5 WHEN 0 THEN 'Answer: there are Năm of ' || t WHEN 1 THEN 'đáp án - 12 or 3 ' || t WHEN 2 THEN 'The red-shirted person is holding a ' || t || '.' WHEN 3 THEN 'answer:' ELSE t END"""


@query(f"""WITH a AS (SELECT conv_id, turn, turn % 2 AS even, trim(regexp_replace({ANSWER_SQL}, '^(?i)(?:answer|đáp\\s*án)\\s*[:\\-]\\s*', ''), ' ' || chr(9) || chr(10) || chr(13)) AS c FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)),
  n AS (SELECT *, list_filter(list_transform(regexp_extract_all({NORM.format(t="c")}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: ({NUMBER_SQL})[w]), lambda x: x IS NOT NULL) AS named, regexp_extract(c, '(^|{NOT_WORD})(\\d+)({NOT_WORD}|$)', 2) AS digits FROM a),
  r AS (SELECT conv_id, turn, CASE WHEN even = 0 THEN CASE WHEN digits <> '' THEN digits WHEN len(named) > 0 THEN named[1] ELSE c END ELSE regexp_replace(trim(regexp_replace(c, '(?i)^(?:the\\s+)?(?:red[- ]shirt(?:ed)?\\s+)?(?:person|man|woman)\\s+(?:is\\s+)?(?:holding|carrying)\\s+', ''), ' .,:;'), '(?i)^(?:a|an|the)\\s+', '') END AS answer FROM n)
  SELECT conv_id, turn, CASE WHEN answer = '' THEN 'unknown' ELSE answer END AS answer FROM r""")
def x20_normal_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers to counting questions (even turns) and about held things (odd ones) in one form."""
    t = F.coalesce("text", F.lit(""))
    k = F.col("conv_id") % 5
    raw = F.when(k == 0, F.concat(F.lit("Answer: there are Năm of "), t)).when(k == 1, F.concat(F.lit("đáp án - 12 or 3 "), t)).when(k == 2, F.concat(F.lit("The red-shirted person is holding a "), t, F.lit("."))).when(k == 3, F.lit("answer:")).otherwise(t)
    c = tables.load(spark, d, "conversations").select("conv_id", "turn", raw.alias("a"), F.when(F.col("turn") % 2 == 0, "count").otherwise("holding").alias("kind"))
    return c.select("conv_id", "turn", qa.normal_answer("a", "kind").alias("answer"))


ASKS = ("how many people", "what is the man holding", "which color", "where")
QA_WORK = f"""base AS ({WORK.removeprefix("work AS (")}, work AS (SELECT query_id, query || chr(10) || 'Visual question: ' || question AS query, question FROM (SELECT *, {list(ASKS)}[query_id % 4 + 1] AS question FROM base))"""


@query(f"""WITH RECURSIVE {KIS_SQL.replace(WORK, QA_WORK)}, {diverse_sql("fused", "query_id", "answers", 50)},
  said AS (SELECT query_id, rank, CASE query_id % 4 WHEN 0 THEN (frame_id % 5)::VARCHAR WHEN 1 THEN CASE WHEN title = '' THEN 'a' ELSE title END ELSE CASE WHEN title = '' THEN 'unknown' ELSE title END END AS answer, (frame_id % 10 + 1) / 10.0::DOUBLE AS confidence FROM answers WHERE rank <= 8),
  support AS (SELECT query_id, lower(answer) AS key, sum(confidence / (1 + 0.10 * greatest(rank - 1, 0))) AS support, min(rank) AS first, arg_min(answer, rank) AS answer, max(confidence) AS confidence FROM said GROUP BY ALL),
  agreed AS (SELECT * FROM support QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(support, 9) DESC, first) = 1)
  SELECT a.query_id, a.rank, a.video_id, a.frame_id, coalesce(s.answer, g.answer) AS answer, round(CASE WHEN s.answer IS NULL THEN g.confidence ELSE s.confidence END, 6) AS qa_confidence FROM answers a LEFT JOIN said s USING (query_id, rank) LEFT JOIN agreed g USING (query_id)""")
def m8_qa_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Questions about every item: split, search, answer the first eight results (a stub stands in for a model), consensus for the rest."""
    work, encode, *engine = item_tables(spark, d)
    asks = F.element_at(F.array(*map(F.lit, ASKS)), (F.col("query_id") % 4 + 1).cast("int"))
    asked = work.select("query_id", F.concat("query", F.lit(". Question: "), asks).alias("query"))
    said = F.when(F.col("kind") == "count", F.concat(F.lit("There are "), (F.col("frame_id") % 5).cast("string"), F.lit(" things"))).when(F.col("kind") == "holding", F.concat(F.lit("a "), "title")).otherwise(F.col("title"))
    stub = lambda rows: rows.withColumn("answer", said).withColumn("confidence", (F.col("frame_id") % 10 + 1) / 10.0)
    out = qa.answered(asked, lambda q: search.known_item_search(q, encode, *engine), stub)
    return out.select("query_id", "rank", "video_id", "frame_id", "answer", r6("qa_confidence"))


@query(f"""WITH {TRUTH}, preds AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rank, 'v' || (user_id % 7) AS video_id, event_id || '.0' AS frame_id, CASE event_id % 4 WHEN 0 THEN 'Màu  đỏ' WHEN 1 THEN 'Năm' WHEN 2 THEN event_type ELSE '' END AS answer FROM events)
  SELECT query_id, rank, video_id, frame_id, answer, (EXISTS (SELECT 1 FROM truth t WHERE t.query_id = p.query_id AND t.video_id = p.video_id AND try_cast(try_cast(p.frame_id AS DOUBLE) AS BIGINT) BETWEEN t.s AND t.e) AND CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN query_id % 2 = 0 WHEN 2 THEN answer = 'view' ELSE false END)::INT::DOUBLE AS score
  FROM (SELECT *, try_cast(try_cast(frame_id AS DOUBLE) AS BIGINT) AS event_id FROM preds) p WHERE rank <= 100""")
def m16_qa_eval(spark: SparkSession, d: str) -> DataFrame:
    """Places and answers together: accepted are do, view, and five for even queries."""
    e = tables.load(spark, d, "events").withColumn("video_id", F.concat(F.lit("v"), (F.col("user_id") % 7).cast("string")))
    answers = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("đo"), F.lit("View"), F.lit("five"))).otherwise(F.array(F.lit("do"), F.lit("view")))
    truth = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("query_id"), "video_id", (F.col("event_id") - 50).alias("start"), (F.col("event_id") + 50).alias("end"))
    accepted = e.select(F.col("user_id").alias("query_id"), answers.alias("answers")).distinct()
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    k = F.col("event_id") % 4
    said = F.when(k == 0, "Màu  đỏ").when(k == 1, "Năm").when(k == 2, F.col("event_type")).otherwise("")
    preds = e.select(F.col("user_id").alias("query_id"), rank.alias("rank"), "video_id", F.concat(F.col("event_id").cast("string"), F.lit(".0")).alias("frame_id"), said.alias("answer"))
    return evaluation.qa_scores(preds, truth, accepted)


# Event sequences.
@query(f"""WITH {ALIGNED}, mapping AS (SELECT video_id, frame_id FROM frames WHERE frame_id % 50 <> 49),
  ev AS (SELECT video_id, unnest(b.path) AS frame_id, generate_subscripts(b.path, 1) AS k FROM best),
  es AS (SELECT e.video_id, k, e.frame_id, CASE k WHEN 1 THEN s0 WHEN 2 THEN s1 ELSE s2 END AS s, m.frame_id IS NOT NULL AS known FROM ev e JOIN wide w USING (video_id, frame_id) LEFT JOIN mapping m USING (video_id, frame_id)),
  sq AS (SELECT video_id, 0.72 * avg(s) + 0.28 * min(s) AS score, bool_and(known) AS known, string_agg(frame_id, ',' ORDER BY k) AS frames FROM es GROUP BY video_id),
  rk AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, video_id)::INTEGER AS rank FROM sq QUALIFY rank <= 10)
  SELECT rank, video_id, round(score, 6) AS score, frames FROM rk WHERE known""")
def m4_trake_search(spark: SparkSession, d: str) -> DataFrame:
    """Videos by their best ordered sequence; one with a frame that has no number goes, and its rank with it."""
    wide = trake.wide_scores(tables.frames(spark, d), tables.query_vectors(spark, d, list(EVENTS3)), 3)
    found = trake.sequence_search(wide, 3, tables.mapping(spark, d), 10)
    return found.select("rank", "video_id", r6("score"), F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


@query(f"""WITH {ENGINE_TABLES}, placed AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY keyframe_number) - 1 AS place FROM mapping),
  centres AS (SELECT video_id, keyframe_number AS centre, place AS at, least(frame_id % 7, 5) AS radius FROM placed WHERE frame_id % 13 = 0)
  SELECT c.video_id, c.centre, p.keyframe_number, p.frame_id FROM centres c JOIN placed p ON p.video_id = c.video_id AND p.place BETWEEN c.at - c.radius AND c.at + c.radius""")
def j8_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The keyframes around some, by place."""
    m = tables.mapping(spark, d)
    centres = m.filter(F.col("frame_id") % 13 == 0).select("video_id", "keyframe_number", (F.col("frame_id") % 7).alias("radius"))
    return trake.neighbours(m, centres).select("video_id", "centre", "keyframe_number", "frame_id")


@query("")
def m6_trake_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Found sequences judged by a pair scorer (here the events' vectors squared) and refined; a test holds it against a plain version."""
    frames, m = tables.frames(spark, d), tables.mapping(spark, d)
    wide = trake.wide_scores(frames, tables.query_vectors(spark, d, list(EVENTS3)), 3)
    found = trake.sequence_search(wide, 3, m, 10).select("rank", "video_id", "score", "keyframes")
    events = spark.createDataFrame([(0, "run up"), (1, "jump"), (2, "landing")], "event int, stage string").withColumn("landing", language.landing("stage"))
    values = wide.join(m.select("video_id", "feature_index", "keyframe_number"), ["video_id", "feature_index"]).select("video_id", "keyframe_number", F.posexplode(F.array("s0", "s1", "s2")).alias("event", "s"))
    judge = lambda rows: rows.join(values, ["video_id", "keyframe_number", "event"]).withColumn("value", F.col("s") * F.col("s"))
    out = trake.rerank(found, events, m, judge)
    return out.select("rank", "video_id", r6("score"), F.array_join(F.transform("keyframes", lambda x: x.cast("string")), ",").alias("keyframes"))


@query(f"""WITH e AS (SELECT conv_id AS query_id, turn AS place, coalesce(text, '') AS event FROM (SELECT DISTINCT conv_id, turn, min(text) OVER (PARTITION BY conv_id, turn) AS text FROM conversations)), r AS (SELECT query_id, row_number() OVER w - 1 AS place, event, lag(event) OVER w AS b, lead(event) OVER w AS a, count(*) OVER (PARTITION BY query_id) AS n FROM e WINDOW w AS (PARTITION BY query_id ORDER BY place))
  SELECT query_id, place, 'Ordered event ' || (place + 1) || '/' || n || '. Exact stage: ' || event || chr(10) || 'Previous stage: ' || coalesce(b, '{language.NO_PREVIOUS}') || chr(10) || 'Next stage: ' || coalesce(a, '{language.NO_NEXT}') AS stage FROM r""")
def w9_event_context(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as a stage of its conversation, with the stages around it."""
    c = tables.load(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("event"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    c = c.select(F.col("conv_id").alias("query_id"), place.cast("long").alias("place"), "event")
    return language.in_sequence(c).select("query_id", "place", "stage")


HINTS = "[" + ", ".join(f"'{w}'" for w in language.VIETNAMESE_HINTS) + "]"


@query(f"""WITH q AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'tim canh ' WHEN 1 THEN 'đi ' ELSE '' END || coalesce(text, '') AS q FROM conversations)
  SELECT conv_id, turn, {NORM.format(t="q")} <> lower(q) OR len(list_intersect(list_distinct(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]+')), {HINTS})) >= 2 AS vietnamese FROM q""")
def x5_language(spark: SparkSession, d: str) -> DataFrame:
    front = F.when(F.col("conv_id") % 3 == 0, "tim canh ").when(F.col("conv_id") % 3 == 1, "đi ").otherwise("")
    c = tables.load(spark, d, "conversations").select("conv_id", "turn", F.concat(front, F.coalesce("text", F.lit(""))).alias("q"))
    return c.select("conv_id", "turn", language.looks_vietnamese("q").alias("vietnamese"))


# Preparation.
BOXES = """box AS (SELECT l_orderkey, l_linenumber, l_partkey % 1280 AS x0, l_suppkey * 37 % 720 AS y0, l_quantity * 8 AS w, l_tax * 500 AS h, ' ' || l_returnflag || ' ' || (l_partkey % 3) AS text, l_discount * 10 AS confidence FROM lineitem),
  r AS (SELECT *, (x0 + x0 + w) / 2 / 1280 AS cx, (y0 + y0 + h) / 2 / 720 AS cy, w / 1280 AS rw, h / 720 AS rh FROM box WHERE confidence >= 0.45),
  o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x0, y0, x0 + w, y0 + h) AS l_linenumber, trim(text) AS line, (cy >= 0.82 AND rh <= 0.14 AND rw >= 0.10) OR (cy <= 0.20 AND (cx <= 0.22 OR cx >= 0.78) AND rh <= 0.12 AND rw <= 0.32) AS over FROM r),
  once AS (SELECT l_orderkey, over, line, min(l_linenumber) AS first, count(*) AS n FROM o GROUP BY ALL),
  f AS (SELECT k.l_orderkey, coalesce(string_agg(line, ' ' ORDER BY first) FILTER (NOT over), '') AS scene_text, coalesce(string_agg(line, ' ' ORDER BY first) FILTER (over), '') AS overlay_text, coalesce(sum(n) FILTER (NOT over), 0)::INTEGER AS scene_boxes, coalesce(sum(n) FILTER (over), 0)::INTEGER AS overlay_boxes
    FROM (SELECT DISTINCT l_orderkey FROM lineitem) k LEFT JOIN once o USING (l_orderkey) GROUP BY ALL)"""


def read_frames(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of every order, as of a frame, split into scene and overlay."""
    x0, y0 = (F.col("l_partkey") % 1280).cast("double"), (F.col("l_suppkey") * 37 % 720).cast("double")
    x1, y1 = x0 + F.col("l_quantity") * 8, y0 + F.col("l_tax") * 500
    text = F.concat(F.lit(" "), "l_returnflag", F.lit(" "), (F.col("l_partkey") % 3).cast("string"))
    box = F.struct("l_linenumber", F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1)).alias("polygon"), text.alias("text"), (F.col("l_discount") * 10).alias("confidence"))
    frames = tables.load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("b"))  # a frame's boxes
    frames = frames.withColumn("b", F.transform("b", lambda x: F.struct(x.polygon.alias("polygon"), x.text.alias("text"), x.confidence.alias("confidence"))))
    return frames.select("l_orderkey", preprocess.frame_text("b", F.lit(1280), F.lit(720)).alias("f")).select("l_orderkey", "f.*")


@query(f"WITH {BOXES} SELECT * FROM f")
def m11_frame_text(spark: SparkSession, d: str) -> DataFrame:
    return read_frames(spark, d)


@query(f"WITH {BOXES} SELECT count(*) AS frames, count(*) FILTER (scene_text <> '') AS records, sum(scene_boxes)::BIGINT AS scene_lines, sum(overlay_boxes)::BIGINT AS overlay_lines, count(*) FILTER (overlay_boxes > 0 AND scene_text = '') AS overlay_only, count(*) FILTER (l_orderkey % 9 = 0) AS failures FROM f")
def a12_run_counters(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.run_counters(read_frames(spark, d).withColumn("failed", F.col("l_orderkey") % 9 == 0))


@query(f"WITH {OCR} SELECT count(*) AS records, coalesce(min(schema), 2)::INTEGER AS least_schema, count(*) FILTER (schema < 2) AS legacy FROM ocr")
def a10_index_statistics(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.index_statistics(tables.records(spark, d))


@query(f"WITH {FRAMES}, v AS (SELECT video_id, count(*) AS n FROM frames GROUP BY 1) SELECT video_id, (sum(n) OVER (ORDER BY video_id) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY video_id))::BIGINT AS \"end\" FROM v")
def w7_offsets(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.offsets(tables.frames(spark, d))


@query("""WITH s AS (SELECT source AS video_id, doc_id % 10 AS keyframe_number, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS schema FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY video_id, keyframe_number ORDER BY schema DESC, length(text) DESC, text) AS n FROM s WHERE trim(text) <> '') SELECT video_id, keyframe_number, sha256(text) AS text_sha256, schema FROM r WHERE n = 1""")
def u4_global_index(spark: SparkSession, d: str) -> DataFrame:
    """Shards merged into one index: what says nothing goes, one record a keyframe."""
    s = tables.load(spark, d, "documents").select(F.col("source").alias("video_id"), (F.col("doc_id") % 10).alias("keyframe_number"), F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(2).alias("schema"))
    return preprocess.global_index(s).select("video_id", "keyframe_number", F.sha2("text", 256).alias("text_sha256"), "schema")


@query("SELECT c_custkey AS video_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)")
def m14_work_list(spark: SparkSession, d: str) -> DataFrame:
    """Work still to be done: customers stand for videos, orders for their markers."""
    o = tables.load(spark, d, "orders").select(F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") % 3).alias("schema"), (F.col("o_orderkey") % 2).alias("rest"))
    videos = tables.load(spark, d, "customer").select(F.col("c_custkey").alias("video_id"))
    return preprocess.work_list(videos, o, {"schema": 0, "rest": 0})


@query("""SELECT event_id AS id, event_id AS rank, 'v' || user_id AS video_id, CASE WHEN event_id % 4 = 0 THEN greatest(event_id - 20, 0) ELSE event_id END AS frame_id, CASE WHEN event_id % 5 = 0 THEN 'put right' ELSE event_type END AS answer FROM events WHERE event_id % 2 = 0""")
def o3_export(spark: SparkSession, d: str) -> DataFrame:
    """Chosen results, with frames and answers that were put right."""
    e = tables.load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("rank"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("video_id"), F.col("event_id").alias("frame_id"), F.col("event_type").alias("answer"))
    frames = e.filter("id % 4 = 0").select("id", (F.col("frame_id") - 20).alias("frame_id"))
    answers = e.filter("id % 5 = 0").select("id", F.lit(" put right ").alias("answer"))
    return files.exported(e, e.filter("id % 2 = 0"), frames, answers)
