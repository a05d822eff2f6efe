"""Diverse selection: greedy temporal gaps, quotas over sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy_gap(df: DataFrame, group: list[str], frame: str, score: str, min_gap: int, max_per_group: int | None, limit: int | None = None) -> DataFrame:
    """Rows kept by a scan of each group by falling score: a row goes if a kept frame lies within `min_gap`, or the group is full.

    Ties go to the smaller frame; a frame that repeats counts once, at its best
    score. The rule never looks across groups, so each group folds by itself.
    A kept frame shuts out 2 * min_gap + 1 frame numbers at most, so the first
    (most - 1) * (2 * min_gap + 1) + 1 frames hold all that can be kept, `most`
    being `max_per_group`, or else the `limit` of rows that the caller takes
    from all groups together; no more are gathered. Null scores and frames go.
    """
    most = min(x for x in (max_per_group, limit) if x is not None)
    key = F.round(F.col(score), 9)
    rows = df.filter(F.col(score).isNotNull() & F.col(frame).isNotNull()).groupBy(*group, F.col(frame).cast("long").alias("_frame")).agg(F.max(F.struct(key.alias("key"), F.col(score).cast("double").alias("score"))).alias("_s"))
    first = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_s.key"), "_frame"))
    rows = rows.withColumn("_n", first).filter(F.col("_n") <= (most - 1) * (2 * min_gap + 1) + 1)
    gathered = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_n", F.col("_frame").alias("frame"), F.col("_s.score").alias("score")))).alias("_rows"))
    empty = F.array().cast("array<struct<_n:int,frame:bigint,score:double>>")

    def step(kept, x):
        return F.when((F.size(kept) < most) & ~F.exists(kept, lambda k: F.abs(k.frame - x.frame) <= min_gap), F.array_append(kept, x)).otherwise(kept)

    folded = gathered.select(*group, F.explode(F.aggregate("_rows", empty, step)).alias("k"))
    return folded.select(*group, F.col("k.frame").alias(frame), F.col("k.score").alias(score))


def video_window(videos: DataFrame, start: int, end: int = 0) -> DataFrame:
    """Rows (one a video) whose 1-based place by video_id lies in start .. end; end 0 means the last. A repeated video_id is an error.

    Only the first `end` rows are gathered to be numbered.
    """
    if start < 1 or (end and end < start):
        raise ValueError("window out of range")
    if videos.groupBy("video_id").count().filter("count > 1").limit(1).count():
        raise ValueError("a video_id occurs twice")
    first = videos.orderBy("video_id").limit(end or videos.count())
    return first.withColumn("ordinal", F.row_number().over(Window.orderBy("video_id"))).filter(F.col("ordinal") >= start)


def shares(visual: float, ocr: float, metadata: float, objects: float, budget: int) -> tuple[int, int, int]:
    """Quotas of visual, text and metadata rows in a budget; halves round to even."""
    clip = lambda x, low, high: min(high, max(low, x))
    parts = clip(visual + 0.35 * objects, 0.30, 0.65), clip(ocr, 0.15, 0.55), clip(metadata, 0.08, 0.30)
    return tuple(max(1, round(budget * p)) for p in parts)


def quota_pool(candidates: DataFrame, group: list[str], budget: int, quotas: tuple[int, int, int], max_per_video: int | None, min_gap: int) -> DataFrame:
    """Candidates (group, video_id, key, frame_id, visual_rank, ocr_rank, metadata_score, score) chosen for reranking, with their place.

    Rows are offered by visual rank, text rank, metadata score and fused score in
    turn; a source takes rows until its quota is met, each key once, no more than
    `max_per_video` a video, and none within `min_gap` frames of a chosen one of
    its video (a gap of 0 asks nothing). What is left of the budget is filled by
    fused score alone. A null rank keeps a row out of that source; ties go to the
    smaller video and key. Sources share the state, so a query folds as a whole:
    its candidates are a recall pool of stated size, not a table.
    """
    item = F.struct(F.col("video_id").cast("string").alias("video"), F.col("key").cast("long").alias("key"), F.col("frame_id").cast("long").alias("frame"))
    turns = [F.col("visual_rank").cast("double"), F.col("ocr_rank").cast("double"), -F.coalesce("metadata_score", F.lit(0.0)), -F.coalesce("score", F.lit(0.0)), -F.coalesce("score", F.lit(0.0))]
    offers = F.array(*[F.struct(F.lit(p).alias("phase"), t.cast("double").alias("turn"), item.video.alias("video"), item.key.alias("key"), item.frame.alias("frame")) for p, t in enumerate(turns)])
    rows = candidates.withColumn("_o", F.filter(offers, lambda o: o.turn.isNotNull())).groupBy(*group).agg(F.array_sort(F.flatten(F.collect_list("_o"))).alias("_o"))
    quota = F.array(*map(F.lit, (*quotas, budget, budget)))

    def step(kept, x):
        fresh = (F.size(kept) < budget) & ~F.exists(kept, lambda k: (k.video == x.video) & (k.key == x.key))
        due = F.size(F.filter(kept, lambda k: k.phase == x.phase)) < F.element_at(quota, x.phase + 1)
        apart = F.lit(True)
        if max_per_video is not None:
            apart &= F.size(F.filter(kept, lambda k: k.video == x.video)) < max_per_video
        if min_gap:
            apart &= ~F.exists(kept, lambda k: (k.video == x.video) & (F.abs(k.frame - x.frame) <= min_gap))
        return F.when(fresh & due & (apart | (x.phase == 4)), F.array_append(kept, x)).otherwise(kept)

    empty = F.array().cast("array<struct<phase:int,turn:double,video:string,key:bigint,frame:bigint>>")
    chosen = rows.select(*group, F.posexplode(F.aggregate("_o", empty, step)).alias("place", "k"))
    return chosen.select(*group, (F.col("place") + 1).alias("place"), "k.phase", F.col("k.video").alias("video_id"), F.col("k.key").alias("key"), F.col("k.frame").alias("frame_id"))
