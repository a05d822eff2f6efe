"""Rank metrics of submitted answers against intervals of truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

CUTOFFS = (1, 5, 20, 50, 100)  # fixed ranks of the score
#: Fixed number words of the answer comparison.
NUMBERS = {
    "khong": "0", "zero": "0", "mot": "1", "one": "1", "hai": "2", "two": "2", "ba": "3", "three": "3", "bon": "4", "tu": "4", "four": "4",
    "nam": "5", "five": "5", "sau": "6", "six": "6", "bay": "7", "seven": "7", "tam": "8", "eight": "8", "chin": "9", "nine": "9", "muoi": "10", "ten": "10",
}


def normalize_answer(column: str | Column) -> Column:
    """Folded text without a leading colour marker, number words as digits."""
    plain = F.trim(F.regexp_replace(X.squeezed(column), "^mau ", ""))
    table = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, plain), plain)


def tolerant_int(column: str):
    """Numbers written as floats are cut to integers; anything else is null."""
    return F.expr(f"try_cast(try_cast({column} AS double) AS bigint)")


def interval_scores(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """1 or 0 for each of the first 100 predictions (query_id, rank, video_id, frame_id): does an interval hold its frame?"""
    p = predictions.filter(F.col("rank") <= 100).withColumn("frame", tolerant_int("frame_id"))
    t = truth.select("query_id", "video_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = p.join(t, (p["query_id"] == t["query_id"]) & (p["video_id"] == t["video_id"]) & p["frame"].between(t["_s"], t["_e"]), "left_semi").select("query_id", "rank", F.lit(1.0).alias("score"))
    return p.join(hit, ["query_id", "rank"], "left").select("query_id", "rank", "video_id", "frame_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def accepted(answer: str, answers: str) -> Column:
    """Whether an answer, in normal form, is one of an array of accepted ones; an empty answer never is."""
    normal = normalize_answer(F.coalesce(F.col(answer), F.lit("")))
    others = F.transform(F.coalesce(answers, F.array().cast("array<string>")), normalize_answer)
    return (normal != "") & F.array_contains(others, normal)


def qa_scores(predictions: DataFrame, truth: DataFrame, answers: DataFrame) -> DataFrame:
    """`interval_scores` times whether the answer is accepted, over predictions with an answer; `answers` (query_id, answers) has one row a query."""
    located = interval_scores(predictions, truth)
    judged = predictions.select("query_id", "rank", "answer").join(answers.select("query_id", "answers"), "query_id", "left")
    right = judged.select("query_id", "rank", "answer", accepted("answer", "answers").cast("double").alias("_a"))
    return located.join(right, ["query_id", "rank"]).select("query_id", "rank", "video_id", "frame_id", "answer", (F.col("score") * F.coalesce("_a", F.lit(0.0))).alias("score"))


def run_summary(seconds: DataFrame) -> DataFrame:
    """(query, mean, least) of measured runs (query, seconds)."""
    return seconds.groupBy("query").agg(F.avg("seconds").alias("mean"), F.min("seconds").alias("least"))


def recall_at(scores: DataFrame) -> DataFrame:
    """The best score up to each cutoff, and their mean, a query."""
    best = [F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("score"))), F.lit(0.0)).alias(f"r{k}") for k in CUTOFFS]
    r = scores.groupBy("query_id").agg(*best)
    return r.withColumn("final_score", sum(F.col(f"r{k}") for k in CUTOFFS) / len(CUTOFFS))


def event_scores(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """For each of the first 100 sequences (query_id, rank, video_id, frames array<string>) the share of events whose interval holds their frame.

    Truth is one row a query (query_id, video_id, intervals array<struct<start, end>>).
    Another video, no truth or no intervals give 0; missing or unreadable frames miss.
    """
    t = truth.select("query_id", F.col("video_id").alias("_v"), "intervals")
    p = predictions.filter(F.col("rank") <= 100).join(t, "query_id", "left")
    inside = F.zip_with("frames", "intervals", lambda f, i: F.coalesce(f.try_cast("double").try_cast("bigint").between(i.start, i.end), F.lit(False)))
    share = F.size(F.filter(inside, lambda x: x)) / F.size("intervals")
    sound = (F.col("video_id") == F.col("_v")) & (F.size("intervals") > 0)
    return p.select("query_id", "rank", "video_id", F.when(sound, share).otherwise(0.0).alias("score"))
