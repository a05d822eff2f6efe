"""Ordered alignment of events over frames: the best strictly increasing choice of one frame an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_alignment(df: DataFrame, group: list[str], order: str, scores: list[str]) -> DataFrame:
    """Rows (group, total, path) by chained running maxima: event e at a frame adds to the best chain that ended before it.

    Ties take the earliest frame. Groups with fewer frames than events have no
    row. All windows share one partitioning and order, hence one shuffle and sort.
    """
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    chain: Column = F.struct(F.col(scores[0]).alias("v"), (-F.col(order)).alias("o"), F.array(F.col(order)).alias("path"))
    out = df.withColumn("_c0", chain)
    for e, s in enumerate(scores[1:], 1):
        out = out.withColumn("_b", F.max(f"_c{e - 1}").over(before))
        out = out.withColumn(f"_c{e}", F.when(F.col("_b").isNotNull(), F.struct((F.col("_b.v") + F.col(s)).alias("v"), (-F.col(order)).alias("o"), F.concat("_b.path", F.array(order)).alias("path"))))
    best = out.groupBy(*group).agg(F.max(f"_c{len(scores) - 1}").alias("b")).filter("b IS NOT NULL")
    return best.select(*group, F.col("b.v").alias("total"), F.col("b.path").alias("path"))


def sequence_score(values: Column) -> Column:
    """0.72 mean + 0.28 min of an array of event scores."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return 0.72 * mean + 0.28 * F.array_min(values)


def candidate_alignment(candidates: DataFrame, group: list[str], events: int) -> DataFrame:
    """Rows (group, total, path) over candidates (group, event 0.., frame_id, score): each event has frames of its own.

    One running maximum an event over a frame range strictly before; NaN and
    infinite scores are left out; a missing event means no row.
    """
    c = candidates.filter(~F.isnan("score") & (F.abs("score") < float("inf")))
    c = c.groupBy(*group, "event", "frame_id").agg(F.max("score").alias("score"))
    before = Window.partitionBy(*group).orderBy("frame_id").rangeBetween(Window.unboundedPreceding, -1)
    out = c.withColumn("_c", F.when(F.col("event") == 0, F.struct(F.col("score").alias("v"), (-F.col("frame_id")).alias("o"), F.array("frame_id").alias("path"))))
    for e in range(1, events):
        prev = F.max(F.when(F.col("event") == e - 1, F.col("_c"))).over(before)
        out = out.withColumn("_b", prev).withColumn(
            "_c",
            F.when(F.col("event") < e, F.col("_c")).when(
                (F.col("event") == e) & F.col("_b").isNotNull(),
                F.struct((F.col("_b.v") + F.col("score")).alias("v"), (-F.col("frame_id")).alias("o"), F.concat("_b.path", F.array("frame_id")).alias("path")),
            ),
        )
    best = out.filter(F.col("event") == events - 1).groupBy(*group).agg(F.max("_c").alias("b")).filter("b IS NOT NULL")
    return best.select(*group, F.col("b.v").alias("total"), F.col("b.path").alias("path"))
