"""Event sequences: search by alignment, neighbours, and reranking with refinement around the best."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import alignment, fusion, vector

#: Fixed: sequences that are refined, the reach around each frame, and the most.
REFINED, RADIUS, MOST_RADIUS = 3, 2, 5


def budgeted(pairs: int, events: int, sequences: int) -> int:
    """Sequences whose frames a budget of scored pairs covers: one at least, if there is any."""
    return min(sequences, max(1, min(max(pairs, 1), 100) // events))


def sequence_search(scored: DataFrame, events: int, mapping: DataFrame, top_videos: int = 10) -> DataFrame:
    """The best ordered sequence of each video over (video_id, feature_index, s0, s1, ..): (rank, video_id, score, path, scores, frames).

    Videos rank by 0.72 mean + 0.28 least of their event scores, ties by name.
    A sequence with a frame that `mapping` does not know goes; ranks keep its gap.
    """
    names = [f"s{e}" for e in range(events)]
    best = alignment.ordered_alignment(scored, ["video_id"], "feature_index", names)
    at = best.select("video_id", "path", F.posexplode("path").alias("event", "feature_index"))
    own = F.element_at(F.array(*names), F.col("event") + 1)
    found = at.join(scored.select("video_id", "feature_index", *names), ["video_id", "feature_index"]).join(mapping.select("video_id", "feature_index", "keyframe_number", "frame_id"), ["video_id", "feature_index"], "left")
    rows = found.groupBy("video_id", "path").agg(F.array_sort(F.collect_list(F.struct("event", own.alias("score"), "frame_id", "keyframe_number"))).alias("f"), F.count("frame_id").alias("n"))  # a row an event
    rows = rows.withColumn("scores", F.transform("f", lambda x: x.score)).withColumn("score", alignment.sequence_score(F.col("scores")))
    top = vector.top_k(rows, top_videos, F.desc(F.round("score", 9)), F.col("video_id")).filter(F.col("n") == events)
    return top.select("rank", "video_id", "score", "path", "scores", F.transform("f", lambda x: x.frame_id).alias("frames"), F.transform("f", lambda x: x.keyframe_number).alias("keyframes"))


def neighbours(mapping: DataFrame, centres: DataFrame) -> DataFrame:
    """Rows of `mapping` (video_id, keyframe_number, ..) within `radius` places of each centre (video_id, keyframe_number, radius, ..).

    Places count a video's keyframes in order, so gaps in their numbers do not
    matter. The centre's columns come along, its number as centre; an unknown
    centre has no rows. Radii are cut to 0 .. 5, so a centre meets 11 rows at most.
    """
    place = (F.row_number().over(Window.partitionBy("video_id").orderBy("keyframe_number")) - 1).alias("place")
    placed = mapping.select("*", place)
    reach = F.least(F.greatest("radius", F.lit(0)), F.lit(MOST_RADIUS)).cast("int")
    at = centres.withColumnRenamed("keyframe_number", "centre").join(placed.select("video_id", F.col("keyframe_number").alias("centre"), F.col("place").alias("_at")), ["video_id", "centre"])
    near = at.withColumn("place", F.explode(F.sequence((F.col("_at") - reach).cast("int"), (F.col("_at") + reach).cast("int")))).drop("_at")
    return near.join(placed, ["video_id", "place"])


def rerank(sequences: DataFrame, events: DataFrame, mapping: DataFrame, score: Callable[[DataFrame], DataFrame], pairs: int = 32, radius: int = RADIUS, refined: int = REFINED) -> DataFrame:
    """Sequences (rank, video_id, score, keyframes) judged by a pair scorer, the best looked at again with neighbouring frames.

    Events are (event 0.., stage, landing). `score` adds value to rows
    (video_id, keyframe_number, event, stage). The first sequences, as many as
    `pairs` allows, take 0.85 of their values' mix and 0.15 of the vector score,
    the others 0.35 of the latter. Of the former the best `refined` choose again
    among frames within `radius` places (one more for landings), in order, and
    take 0.88 and 0.12. Rows (rank, video_id, score, keyframes).
    """
    n = events.count()
    total = sequences.count()
    limit = budgeted(pairs, n, total)
    base = vector.min_max_of_all(sequences, "score", "clip")
    base = base.withColumn("_place", F.row_number().over(Window.orderBy("rank")))  # the videos that search returned, 100 at most
    frames = base.filter(F.col("_place") <= limit).select("video_id", F.posexplode("keyframes").alias("event", "keyframe_number")).join(events, "event")
    judged = score(frames).groupBy("video_id").agg(F.avg("value").alias("mean"), F.min("value").alias("least"))
    base = base.join(judged, "video_id", "left").withColumn("_s", fusion.sequence_rerank(F.col("mean"), F.col("least"), F.col("clip"), F.lit(False)))
    best = base.filter(F.col("mean").isNotNull()).orderBy(F.desc(F.round("_s", 9)), "_place").limit(max(0, min(refined, 5)))
    centres = best.select("video_id", F.posexplode("keyframes").alias("event", "keyframe_number")).join(events, "event")
    reach = F.lit(min(max(radius, 0), 4)) + F.when(F.col("landing"), 1).otherwise(0)
    near = neighbours(mapping.select("video_id", "keyframe_number"), centres.withColumn("radius", reach))
    values = score(near.select("video_id", "keyframe_number", "event", "stage")).select("video_id", "event", F.col("keyframe_number").alias("frame_id"), F.col("value").alias("score"))
    again = alignment.candidate_alignment(values, ["video_id"], n).select("video_id", F.col("path").alias("keyframes"))
    at = again.select("video_id", F.posexplode("keyframes").alias("event", "frame_id")).join(values, ["video_id", "event", "frame_id"])
    finer = at.groupBy("video_id").agg(F.avg("score").alias("_m"), F.min("score").alias("_l")).join(again.withColumnRenamed("keyframes", "_k"), "video_id")
    out = base.join(finer, "video_id", "left")
    out = out.withColumn("_s", F.when(F.col("_k").isNotNull() & F.lit(radius > 0), fusion.sequence_rerank(F.col("_m"), F.col("_l"), F.col("clip"), F.lit(True))).otherwise(F.col("_s")))
    out = out.withColumn("keyframes", F.coalesce("_k", "keyframes") if radius > 0 else F.col("keyframes"))
    order = (F.desc(F.round("_s", 9)), F.col("_place"))
    return out.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "video_id", F.col("_s").alias("score"), "keyframes")


def wide_scores(frames: DataFrame, vectors: DataFrame, events: int) -> DataFrame:
    """(video_id, feature_index, frame_id, s0, s1, ..): every frame against every event's vector (query_id, qvec)."""
    s = vector.scored(frames, vectors)
    columns = [F.max(F.when(F.col("query_id") == e, F.col("score"))).alias(f"s{e}") for e in range(events)]
    return s.groupBy("video_id", "feature_index", "frame_id").agg(*columns)


