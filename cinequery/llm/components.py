"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, scratch: Scratch | None = None, name: str = "links") -> DataFrame:
    """Rows (node, component) for every node of `links` (u, v: long); the component is its smallest node.

    Null ends and self links are ignored; repeated links count once; no links
    give no rows. Each step is one or two group-by joins over the links, which
    shrink to stars; tables between steps are written to the shared folder,
    where only the last stays, under `name` in `scratch` if that is given.
    A hub's neighbours stay rows and are never gathered into one list.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = scratch.write(edges.filter("u > v").distinct(), name)
    before = None
    while (now := _signature(edges)) != before and now[0]:
        before = now
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of a node goes to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = scratch.write(small.filter("u > v").distinct(), name)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
