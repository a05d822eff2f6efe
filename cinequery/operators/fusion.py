"""Scores of rerankers mixed with retrieval scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def rerank_score(joint: Column, visual: Column, support: Column, explicit_ocr: Column) -> Column:
    """Queries for visible text trust the joint score; others also need the picture to fit."""
    j, v, s = X.clip(joint), X.clip(visual), X.clip(support)
    return F.when(explicit_ocr, 0.72 * j + 0.28 * s).otherwise(0.42 * j + 0.58 * (0.70 * v + 0.30 * s))


def cap_outside(df: DataFrame, keys: list[str], in_pool: str, score: str) -> DataFrame:
    """Rows that were not reranked stay below all that were: at most the pool's lowest score less 0.001; no pool, no cap."""
    floor = F.min(F.when(F.col(in_pool), F.col(score))).over(Window.partitionBy(*keys))
    capped = F.when(F.col(in_pool) | floor.isNull(), F.col(score)).otherwise(F.least(F.col(score), floor - 0.001))
    return df.withColumn(score, capped)


def sequence_rerank(mean: Column, least: Column, clip: Column, refined: Column) -> Column:
    """Event scores of a sequence with its min-max vector score; without event scores (null) the vector score alone, damped."""
    events = 0.72 * mean + 0.28 * least
    return F.when(mean.isNull(), 0.35 * clip).when(refined, 0.88 * events + 0.12 * clip).otherwise(0.85 * events + 0.15 * clip)
