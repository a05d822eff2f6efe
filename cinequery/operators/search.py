"""The search engines: recall by vector, metadata, object evidence, diversity; and the known-item pipeline over several sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import bm25, preprocess, router, select, vector

# Fixed values of the engines.
OBJECT_BUDGET, OBJECT_BONUS = 300, 0.03
PLAIN_WEIGHT, MOST_WEIGHT = 0.025, 0.35
ONLY_TEXT = 0.55
BOTH_VISUAL, BOTH_TEXT, BOTH_METADATA = 0.40, 0.45, 0.10
RETRIEVAL_SHARE, SUPPORT_SHARE = 0.22, 0.78
SOURCES = ("visual", "object", "metadata")


@dataclass(frozen=True)
class Options:
    """Options of a search within their bounds: 1..100 rows, gaps of 0..600 frames, 1..100 rows a video (0: no bound)."""

    top_k: int = 100
    min_gap: int = 0
    max_per_video: int | None = 4

    @classmethod
    def clamped(cls, top_k: object = None, dedupe: object = None, max_per_video: object = None) -> Options:
        """Any values, as a form sends them; what is no number takes the default."""

        def whole(value: object, default: int, low: int, high: int) -> int:
            try:
                return min(high, max(low, int(str(value).strip())))
            except ValueError:
                return default

        most = whole(max_per_video, 4, 0, 100)
        return cls(whole(top_k, 100, 1, 100), whole(dedupe, 0, 0, 600), most or None)

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 100:
            raise ValueError("top_k must lie in 1..100")
        if self.min_gap < 0:
            raise ValueError("min_gap must not be negative")
        if self.max_per_video is not None and self.max_per_video < 1:
            raise ValueError("max_per_video must be positive")


def recall_pool(top_k: int, videos: str = "all") -> int:
    """Rows of first recall: 30 a result and 800 at least; eight times as many within one video, three times with a filter."""
    return max(800, 30 * top_k) * {"all": 1, "one": 8, "some": 3}[videos]


def refine_pool(top_k: int, pool: int = 1200) -> int:
    return max(pool, 30 * top_k)


def only_video(frames: DataFrame, video_id: str | None) -> DataFrame:
    """The frames of one video; an unknown video is an error."""
    if video_id is None:
        return frames
    found = frames.filter(F.col("video_id") == video_id)
    if found.limit(1).count() == 0:
        raise ValueError(f"no video {video_id}")
    return found


def object_match(labels: str, query_tokens: Column) -> Column:
    """The share of the query's different tokens that occur in the labels."""
    own = F.array_distinct(F.flatten(F.transform(F.coalesce(labels, F.array().cast("array<string>")), X.tokens)))
    asked = F.array_distinct(query_tokens)
    return F.when((F.size(own) == 0) | (F.size(asked) == 0), 0.0).otherwise(F.size(F.array_intersect(own, asked)) / F.size(asked))


def _with_evidence(searches: DataFrame, frames: DataFrame, mapping: DataFrame, metadata: DataFrame, top_k: int) -> DataFrame:
    """The pool of each search, mapped to keyframes, with visual and metadata scores and the search's weight and tokens."""
    pool = vector.recall(frames, searches.select("query_id", "qvec"), recall_pool(top_k)).withColumnRenamed("score", "visual")
    pool = pool.join(mapping.select("video_id", F.col("feature_index").cast("long").alias("feature_index"), "keyframe_number", "frame_id"), ["video_id", "feature_index"])
    docs = metadata.select(F.col("video_id").alias("doc"), F.concat_ws(" ", "title", "description", F.array_join("keywords", " ")).alias("text"))
    asked = pool.select("query_id", F.col("video_id").alias("doc"))
    known = bm25.metadata_search(docs, searches.select("query_id", "query"), asked).select("query_id", F.col("doc").alias("video_id"), F.col("score").alias("metadata"))
    weight = searches.select("query_id", F.least(F.greatest("metadata_weight", F.lit(0.0)), F.lit(MOST_WEIGHT)).alias("mw"), X.tokens(F.coalesce("query", F.lit(""))).alias("asked"))
    titles = metadata.select("video_id", "title")
    out = pool.join(known, ["query_id", "video_id"]).join(weight, "query_id").join(titles, "video_id", "left")
    return out.withColumn("title", F.coalesce("title", F.lit("")))


def _ranked(df: DataFrame, score: str, limit: int) -> DataFrame:
    return vector.top_per_group(df, limit, ["query_id"], F.desc(F.round(score, 9)), F.col("video_id"), F.col("frame_id"))


def _diverse(df: DataFrame, score: str, options: Options) -> DataFrame:
    """The rows of `df` (query_id, video_id, frame_id, ..) that the greedy scan keeps, ranked, the first top_k of each query."""
    kept = select.greedy_gap(df, ["query_id", "video_id"], "frame_id", score, options.min_gap, options.max_per_video, options.top_k)
    rows = df.join(kept.select("query_id", "video_id", "frame_id"), ["query_id", "video_id", "frame_id"])
    rows = vector.top_per_group(rows, 1, ["query_id", "video_id", "frame_id"], F.desc(score), F.col("keyframe_number")).drop("rank")
    return _ranked(rows, score, options.top_k)


def feature_search(searches: DataFrame, frames: DataFrame, mapping: DataFrame, metadata: DataFrame, objects: DataFrame, options: Options) -> DataFrame:
    """Searches (query_id, query, qvec, metadata_weight) over frames: recall, metadata, object bonus, then diversity.

    Rows (query_id, rank, video_id, keyframe_number, frame_id, title, labels,
    visual, metadata, object, score). `mapping` gives frames' numbers; vectors
    without one are left out. Only the first 300 rows of a search read object
    labels (video_id, keyframe_number, labels); the bonus breaks ties, no more.
    """
    rows = _with_evidence(searches, frames, mapping, metadata, options.top_k)
    rows = rows.withColumn("base", (1 - F.col("mw")) * F.col("visual") + F.col("mw") * F.col("metadata"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("base", 9)), "video_id", "feature_index"))
    rows = rows.withColumn("place", place)
    seen = _labelled(rows.filter(F.col("place") <= OBJECT_BUDGET), objects)
    rest = rows.filter(F.col("place") > OBJECT_BUDGET).withColumn("labels", F.array().cast("array<string>")).withColumn("object", F.lit(0.0))
    scored = seen.unionByName(rest).withColumn("score", F.col("base") + OBJECT_BONUS * F.col("object"))
    return _diverse(scored, "score", options).select(*COLUMNS)


COLUMNS = ("query_id", "rank", "video_id", "keyframe_number", "frame_id", "title", "labels", "visual", "metadata", "object", "score")


def _labelled(rows: DataFrame, objects: DataFrame) -> DataFrame:
    found = rows.join(objects.select("video_id", "keyframe_number", "labels"), ["video_id", "keyframe_number"], "left")
    found = found.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    return found.withColumn("object", object_match("labels", F.col("asked")))


def direct_search(searches: DataFrame, frames: DataFrame, mapping: DataFrame, metadata: DataFrame, objects: DataFrame, options: Options) -> DataFrame:
    """The other engine's order over the same tables: diversity by vector score first, then the object bonus and a new ranking.

    The metadata weight plays no part; columns as in `feature_search`.
    """
    rows = _with_evidence(searches, frames, mapping, metadata, options.top_k)
    kept = _diverse(rows.withColumn("base", F.col("visual")), "base", options).drop("rank")
    kept = _labelled(kept, objects).withColumn("score", F.col("visual") + OBJECT_BONUS * F.col("object"))
    return _ranked(kept, "score", options.top_k).select(*COLUMNS)


def analysed(queries: DataFrame) -> DataFrame:
    """Queries (query_id, query) with weights w, and texts for each modality."""
    c = queries.withColumn("_c", router.clauses("query")).withColumn("_s", router.scored_clauses("_c"))
    texts = F.struct(*[F.trim(router.query_for("_s", m)).alias(m) for m in router.MODALITIES])
    return c.select("query_id", "query", router.weights("_s").alias("w"), texts.alias("texts"), router.explicit_ocr("query").alias("explicit"))


def source_queries(analysis: DataFrame) -> DataFrame:
    """Rows (query_id, source, place, query, metadata_weight): each different text once, in the order of SOURCES; the whole query if there is none."""
    texts = F.filter(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(m).alias("source"), F.col(f"texts.{m}").alias("query")) for k, m in enumerate(SOURCES)]), lambda x: x.query != "")
    first = F.filter(texts, lambda x, i: ~F.exists(F.slice(texts, F.lit(1), i), lambda y: y.query == x.query))
    whole = F.array(F.struct(F.lit(0).alias("place"), F.lit("visual").alias("source"), F.coalesce("query", F.lit("")).alias("query")))
    rows = analysis.select("query_id", "w", F.explode(F.when(F.size(first) > 0, first).otherwise(whole)).alias("s")).select("query_id", "w", "s.*")
    weight = F.when(F.col("source") == "metadata", F.least(F.lit(0.30), PLAIN_WEIGHT + 0.32 * F.col("w.metadata"))).otherwise(PLAIN_WEIGHT)
    return rows.select("query_id", "source", "place", "query", weight.alias("metadata_weight"))


def merged(results: DataFrame) -> DataFrame:
    """Results of several sources (query_id, place of the source, ..) by keyframe: best scores, first title that is not empty, labels in order."""
    titled = F.when(F.col("title") != "", F.col("place"))
    labels = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "labels"))), lambda x: x.labels)))  # a row a source
    best = [F.max(c).alias(c) for c in ("visual", "metadata", "object", "score")]
    return results.groupBy("query_id", "video_id", "keyframe_number").agg(F.first("frame_id").alias("frame_id"), F.coalesce(F.min_by("title", titled), F.lit("")).alias("title"), labels.alias("labels"), *best)


def text_evidence(records: DataFrame, places: DataFrame, mapping: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """Text hits of queries (query_id, query) as keyframes: (query_id, video_id, keyframe_number, frame_id, ocr, ocr_quality, ocr_text).

    `records` are (doc, text, schema, quality), `places` their (doc, video_id,
    keyframe_number); hits without a mapped keyframe are left out. Only hits
    meet their texts and places. Quality counts in the hit's score and once
    more in its worth as evidence.
    """
    hits = bm25.ocr_search(records.select("doc", "text", "quality"), queries, max(200, min(4 * top_k, 400)))
    rows = hits.select("query_id", "doc", "score", "quality").join(records.select("doc", "text", "schema"), "doc").join(places.select("doc", "video_id", "keyframe_number"), "doc")
    rows = rows.join(mapping.select("video_id", "keyframe_number", "frame_id"), ["video_id", "keyframe_number"])
    text = preprocess.trusted_text("text", "quality", "schema")
    return rows.select("query_id", "video_id", "keyframe_number", "frame_id", (F.col("score") * F.col("quality")).alias("ocr"), F.col("quality").alias("ocr_quality"), text.alias("ocr_text"))


def joined(visual: DataFrame, text: DataFrame) -> DataFrame:
    """Visual candidates and text hits in full, each with its score: a hit alone counts 0.55; one that meets a candidate can only raise it."""
    keys = ["query_id", "video_id", "keyframe_number"]
    v = visual.withColumnRenamed("frame_id", "_v").withColumn("_found", F.lit(True))
    j = v.join(text.withColumnRenamed("frame_id", "_o"), keys, "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = F.greatest("score", BOTH_VISUAL * F.col("visual") + BOTH_TEXT * F.col("ocr") + BOTH_METADATA * F.col("metadata"))
    score = F.when(F.col("_found").isNull(), ONLY_TEXT * F.col("ocr")).when(F.col("ocr").isNull(), F.col("score")).otherwise(both)
    return j.select(*keys, F.coalesce("_v", "_o").alias("frame_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), *[zero(c).alias(c) for c in ("visual", "metadata", "object", "ocr")], F.coalesce("ocr_quality", F.lit(1.0)).alias("ocr_quality"), F.coalesce("ocr_text", F.lit("")).alias("ocr_text"), score.alias("retrieval"))


def support(w: str, visual: Column, ocr: Column, metadata: Column, objects: Column) -> Column:
    """The four scores, cut to 0 .. 1, by the query's weights."""
    parts = {"visual": visual, "ocr": ocr, "metadata": metadata, "object": objects}
    return sum((F.col(f"{w}.{m}") * X.clip(parts[m]) for m in router.MODALITIES), F.lit(0.0))


def adaptive(rows: DataFrame, analysis: DataFrame) -> DataFrame:
    """`rows` with score: normalised retrieval, and support by the query's weights."""
    rows = rows.join(analysis.select("query_id", "w"), "query_id")
    rows = rows.withColumn("_r", vector.min_max("retrieval", ["query_id"])).withColumn("_v", vector.min_max("visual", ["query_id"]))
    s = support("w", F.col("_v"), F.col("ocr"), F.col("metadata"), F.col("object"))
    return rows.withColumn("score", RETRIEVAL_SHARE * F.col("_r") + SUPPORT_SHARE * s).drop("_r", "_v", "w")


def candidates(queries: DataFrame, encode: Callable[[DataFrame], DataFrame], frames: DataFrame, mapping: DataFrame, metadata: DataFrame, objects: DataFrame, records: DataFrame, places: DataFrame, options: Options) -> DataFrame:
    """All candidates of queries (query_id long, query) with every score, fused. `encode` adds qvec to rows (query_id, source, place, query, ..)."""
    analysis = analysed(queries)
    searches = encode(source_queries(analysis)).withColumn("search", F.col("query_id") * len(SOURCES) + F.col("place"))
    one = searches.select(F.col("search").alias("query_id"), "query", "qvec", "metadata_weight")
    found = feature_search(one, frames, mapping, metadata, objects, options).withColumnRenamed("query_id", "search")
    named = found.withColumn("query_id", F.floor(F.col("search") / len(SOURCES))).withColumn("place", F.col("search") % len(SOURCES))
    asked = analysis.select("query_id", F.col("texts.ocr").alias("query")).filter("query != ''")
    text = text_evidence(records, places, mapping, asked, options.top_k)
    return adaptive(joined(merged(named), text), analysis)


def known_item_search(queries: DataFrame, encode: Callable[[DataFrame], DataFrame], frames: DataFrame, mapping: DataFrame, metadata: DataFrame, objects: DataFrame, records: DataFrame, places: DataFrame, options: Options) -> DataFrame:
    """Ranked answers of every query: sources are searched apart, merged, joined with text, fused and thinned out in time."""
    rows = candidates(queries, encode, frames, mapping, metadata, objects, records, places, options)
    return _diverse(rows, "score", options)
