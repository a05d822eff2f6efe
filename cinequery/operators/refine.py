"""Coarse-to-fine refinement over frame numbers."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from . import alignment


def modulo_schedule(text: str) -> list[int]:
    """Steps such as "4,2,1": falling, each a divisor of the one before, ending in 1, none over 300."""
    steps = [int(x) for x in text.split(",")]
    sound = steps and steps[-1] == 1 and all(1 <= s <= 300 for s in steps) and all(a > b and a % b == 0 for a, b in zip(steps, steps[1:], strict=False))
    if not sound:
        raise ValueError(f"bad modulo schedule: {text}")
    return steps


def refine(frames: DataFrame, chosen: DataFrame, previous: int, step: int) -> DataFrame:
    """Frames within previous steps of a chosen frame (video_id, frame_id) whose number `step` divides, once each.

    The range is also an equality on blocks of `reach` frames (own, before,
    after), so that the join hashes and a long video spreads over keys.
    """
    reach = max(1, previous)
    block = lambda c: F.floor(F.col(c) / reach)
    near = chosen.select("video_id", F.col("frame_id").alias("c"), F.explode(F.sequence(block("frame_id") - 1, block("frame_id") + 1)).alias("b"))
    hit = frames.filter(F.col("frame_id") % step == 0).withColumn("b", block("frame_id")).join(near, ["video_id", "b"])
    return hit.filter(F.abs(F.col("frame_id") - F.col("c")) <= reach).drop("b", "c").dropDuplicates(["video_id", "frame_id"])


def refine_sequences(scored: DataFrame, events: int, steps: list[int], top_videos: int, pool: int = 50) -> DataFrame:
    """Ordered events coarse to fine over (video_id, frame_id, s0, s1, ..): (rank, video_id, path, score).

    The best alignment of frames that the first step divides picks
    max(top_videos, pool) videos; then each event looks around its own frame at
    each finer step and the videos are aligned again. A video without a new
    alignment keeps what it had. Scores are 0.72 mean + 0.28 least. The scores
    and each step's choice are written to the shared folder.
    """
    scratch = Scratch(scored.sparkSession, "refine")
    scored = scratch.write(scored, "scored")
    names = [f"s{e}" for e in range(events)]
    coarse = alignment.ordered_alignment(scored.filter(F.col("frame_id") % steps[0] == 0), ["video_id"], "frame_id", names)

    def judged(paths: DataFrame) -> DataFrame:
        at = paths.select("video_id", "path", F.posexplode("path").alias("event", "frame_id"))
        own = F.element_at(F.array(*names), F.col("event") + 1)
        found = at.join(scored, ["video_id", "frame_id"]).groupBy("video_id", "path").agg(F.avg(own).alias("m"), F.min(own).alias("l"))
        return found.select("video_id", "path", (0.72 * F.col("m") + 0.28 * F.col("l")).alias("score"))

    best = judged(coarse).orderBy(F.desc(F.round("score", 9)), "video_id").limit(max(top_videos, pool)).select("video_id", "path")
    best = scratch.write(best, "best")
    for previous, step in zip(steps, steps[1:], strict=False):
        around = []
        for e in range(events):
            centre = best.select("video_id", F.element_at("path", e + 1).alias("frame_id"))
            near = refine(scored, centre, previous, step)
            around.append(near.select("video_id", F.lit(e).alias("event"), "frame_id", F.col(names[e]).alias("score")))
        finer = alignment.candidate_alignment(functools.reduce(DataFrame.unionByName, around), ["video_id"], events)
        best = scratch.write(best.join(finer.select("video_id", F.col("path").alias("_p")), "video_id", "left").select("video_id", F.coalesce("_p", "path").alias("path")), "best")
    order = (F.desc(F.round("score", 9)), F.col("video_id"))
    top = judged(best).orderBy(*order).limit(top_videos)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "video_id", "path", "score")
