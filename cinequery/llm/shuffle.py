"""Sharding by a two-pass external shuffle.

Pass one scatters records by a seeded hash into buckets that fit in memory.
Pass two orders each bucket by record, so that a lost executor's work comes out
the same again, shuffles it by Fisher-Yates with the bucket's own seed, and
writes it. Buckets end to end are one uniform order of all records, which is cut
into shards whose row counts are at most one apart. Records that repeat beyond
a bucket's share are scattered one by one, as they are alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BUCKET_BYTES = 16 << 20
#: A record whose copies weigh more than this share of a bucket is scattered copy by copy.
CROWD = 0.25


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform order of 0 .. n-1: from the end, each place changes with one at or before it."""
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist(), strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffled_shards(records: DataFrame, size_column: str, key_columns: list[str], shards: int = 8, seed: int = 1, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The records with `shard` (0 .. shards-1) and `slot` (0 .. in each shard, no gaps), written and read back.

    `size_column` gives a record's bytes, null counting none; `key_columns` tell
    records apart for the hash. Law: rows, that is shard sizes differ by one
    record at most. Rows that repeat are records of their own, whatever their
    number. Records keep all their columns, whatever their names; input columns
    named shard or slot are replaced. Empty tables give no rows.
    """
    names = [c for c in records.columns if c not in ("shard", "slot")]
    place = {c: f"_in{i}" for i, c in enumerate(names)}  # no other column can clash with these
    d = records.select(*names).toDF(*place.values())
    size, keys = F.coalesce(F.col(place[size_column]), F.lit(0)), [place[c] for c in key_columns]
    total, n = d.agg(F.sum(size), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    d = d.withColumn("tie", F.xxhash64(*keys, F.lit(seed)))
    # few records can be so heavy: their copies weigh more than a quarter of a bucket
    heavy = d.groupBy("tie").agg(F.sum(size).alias("_w"), F.count("*").alias("_n")).filter((F.col("_w") > CROWD * bucket_bytes) & (F.col("_n") > 1)).select("tie", F.lit(True).alias("heavy"))
    d = d.join(heavy, "tie", "left") if buckets > 1 and heavy.limit(1).count() else d.withColumn("heavy", F.lit(None).cast("boolean"))
    scattered = F.when(F.col("heavy"), F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))).otherwise(F.col("tie"))
    d = d.select(*place.values(), "tie", F.pmod(scattered, F.lit(buckets)).cast("int").alias("bucket"))

    def shuffle(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tie", "ascending"), *((c, "ascending") for c in keys)])
        bucket = t.column("bucket")[0].as_py() if len(t) else 0
        t = t.take(pa.array(fisher_yates(len(t), np.random.default_rng([seed, bucket]))))
        return t.drop_columns(["tie"]).append_column("place", pa.array(np.arange(len(t)), pa.int64()))

    schema = d.drop("tie").withColumn("place", F.lit(0).cast("long")).schema
    placed = Scratch(records.sparkSession, "shuffled").write(d.groupBy("bucket").applyInArrow(shuffle, schema), "placed")
    # a row a bucket; Spark broadcasts the offsets where their size allows
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("_n"))
    offsets = sizes.select("bucket", (F.sum("_n").over(Window.orderBy("bucket")) - F.col("_n")).alias("offset"))
    position = (F.col("offset") + F.col("place")).alias("position")
    small, larger = divmod(n, shards)  # the first `larger` shards have one record more
    cut = larger * (small + 1)
    first = F.col("position") < cut
    shard = F.when(first, F.expr(f"position div {small + 1}")).otherwise(F.expr(f"{larger} + (position - {cut}) div {max(small, 1)}"))
    slot = F.when(first, F.expr(f"position % {small + 1}")).otherwise(F.expr(f"(position - {cut}) % {max(small, 1)}"))
    out = placed.join(offsets, "bucket").select(*place.values(), position)
    return out.select(*place.values(), shard.cast("int").alias("_shard"), slot.alias("_slot")).toDF(*names, "shard", "slot")
