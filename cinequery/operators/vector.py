"""Vector scores in double precision: as expressions, or as one matrix product an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: str | Column) -> Column:
    """L2-normalised vector; the norm is 1e-12 at least."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


#: Queries that are met in one block, at most.
FEW_QUERIES = 1000


def scored(frames: DataFrame, queries: DataFrame) -> DataFrame:
    """Every frame against every query (query_id, qvec); queries are a stated set of a few rows, read in one block. For more, see `recall`."""
    if queries.limit(FEW_QUERIES + 1).count() > FEW_QUERIES:
        raise ValueError(f"more than {FEW_QUERIES} queries")
    return frames.join(F.broadcast(queries)).withColumn("score", cosine("embedding", "qvec"))


#: Cells of the query vectors in one block; a block is broadcast, 8 bytes a cell.
BLOCK_CELLS = 4 << 20


def recall(frames: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """The `pool` best frames (video_id, feature_index, embedding) of each query (query_id, qvec) by cosine: (query_id, video_id, feature_index, score).

    Queries are streamed to the driver in blocks of bounded size, each one pass
    over the frames. A task keeps its `pool` best a query, ties at the edge
    included; ties in the end go to the smaller video and index. Vectors that
    are null, hold nulls or have another length than the query take no part.
    """
    kind = dict(queries.dtypes)["query_id"]
    schema = f"query_id {kind}, video_id string, feature_index long, score double"
    out = None
    for ids, vectors in _blocks(queries):
        shared = frames.sparkSession.sparkContext.broadcast((ids, vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            kept: list = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
            videos, places, seen = [], [], 0
            for b in batches:
                lists = [v if v is not None and len(v) == q.shape[1] and None not in v else None for v in b.column(2).to_pylist()]
                good = np.array([v is not None for v in lists], bool)
                if not good.any():
                    continue
                e = np.array([v for v in lists if v is not None], np.float64)
                videos.append(b.column(0).filter(pa.array(good)))
                places.append(b.column(1).filter(pa.array(good)).to_numpy())
                scores = (q @ e.T) / np.maximum(np.linalg.norm(e, axis=1), 1e-12)
                rows = np.arange(seen, seen + len(e))
                seen += len(e)
                for k, (had, at) in enumerate(kept):
                    s, r = np.concatenate([had, scores[k]]), np.concatenate([at, rows])
                    if len(s) > pool:
                        keep = s >= np.partition(s, len(s) - pool)[len(s) - pool] - 1e-12
                        s, r = s[keep], r[keep]
                    kept[k] = s, r
            if seen:
                names, place = pa.concat_arrays(videos), np.concatenate(places)
                for k, (s, r) in enumerate(kept):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k]] * len(r), pa.int64()), names.take(pa.array(r)), pa.array(place[r], pa.int64()), pa.array(s)], ["query_id", "video_id", "feature_index", "score"])

        found = frames.select("video_id", F.col("feature_index").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "query_id long, video_id string, feature_index long, score double")
        out = found if out is None else out.union(found)
    if out is None:
        return frames.sparkSession.createDataFrame([], schema)
    out = out.select(F.col("query_id").cast(kind), "video_id", "feature_index", "score")
    return top_per_group(out, pool, ["query_id"], F.desc(F.round("score", 9)), F.col("video_id"), F.col("feature_index")).drop("rank")


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    ids, vectors, cells = [], [], 0
    for r in queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec")).filter("qvec is not null").orderBy("query_id").toLocalIterator():
        if vectors and (cells + len(r.qvec) > BLOCK_CELLS or len(r.qvec) != len(vectors[0])):
            yield ids, np.array(vectors)
            ids, vectors, cells = [], [], 0
        ids.append(r.query_id)
        vectors.append(r.qvec)
        cells += len(r.qvec)
    if vectors:
        yield ids, np.array(vectors)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows by `order`, with rank 1 .. k: a bounded heap a task, then one merge."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_per_group(df: DataFrame, n: int, keys: list[str], *order: Column) -> DataFrame:
    """The first n rows of each group (a group limit runs before the shuffle)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def min_max(x: str, keys: list[str]) -> Column:
    """Min-max normalised within the group; flat groups give 0.5."""
    w = Window.partitionBy(*keys)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high - low < 1e-9, F.lit(0.5)).otherwise((F.col(x) - low) / (high - low))


def min_max_of_all(df: DataFrame, column: str, name: str) -> DataFrame:
    """`df` with the column min-max normalised over all rows, as `name`: its two bounds come as one broadcast row."""
    bounds = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    flat = F.col("_high") - F.col("_low") < 1e-9
    return df.join(F.broadcast(bounds)).withColumn(name, F.when(flat, 0.5).otherwise((F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low")))).drop("_low", "_high")
