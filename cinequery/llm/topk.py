"""Exact top-k inner products over an impact-ordered index, processed score at a time.

Vectors are quantised to integers and cut into shards. A shard's index is built
once and holds, for each dimension, its postings in segments of falling value;
all queries stream past it in batches. For a query, a segment's
quantised impact is the most that a posting in it can add to the score. Segments
are taken by falling impact; every vector has an upper bound, made of the
impacts read and, for dimensions still to come, the largest impact unread there.
Reading stops only once the vectors whose bound reaches the k-th best exact score
found so far are few; they are then scored exactly. Queries of a batch share each
pass, which is one matrix product of impacts and segment membership.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import project

LEVELS = 16
#: Shares of a query's segments read before each test for a proof; the last reads all.
SHARES = (0.75, 1.0)
#: Queries in one matrix product, and cells of the membership matrix held at once.
TOGETHER, CELLS = 256, 1 << 23


class ImpactIndex:
    """Postings of one shard: per dimension, vectors by falling value in LEVELS segments (taken backwards for negative weights)."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        n, dims = vectors.shape
        order = np.argsort(-vectors, axis=0, kind="stable")
        cuts = np.unique(np.linspace(0, n, min(levels, n) + 1).astype(int))
        columns = np.arange(dims)
        self.top = vectors[order[cuts[:-1]], columns].astype(float)  # the largest value of each segment, levels x dims
        self.bottom = vectors[order[cuts[1:] - 1], columns].astype(float)
        self.segment = np.empty((n, dims), np.int32)  # of each posting, counted dimension by dimension
        level = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        self.segment[order, columns] = level[:, None] + columns * len(self.top)

    def search(self, q: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, segments read): every row that can be among the k best, row `skip` left out, with its exact score."""
        return self.search_all(q[None], k, np.array([skip]))[0]

    def search_all(self, queries: np.ndarray, k: int, skip: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """`search` for each row of `queries`."""
        found: list = [None] * len(queries)
        for start in range(0, len(queries), TOGETHER):
            self._together(queries, k, skip, np.arange(start, min(start + TOGETHER, len(queries))), found)
        return found

    def _together(self, queries: np.ndarray, k: int, skip: np.ndarray, left: np.ndarray, found: list) -> None:
        n, dims = self.vectors.shape
        if n <= k + 1:
            for i in left:
                found[i] = self._exact(np.delete(np.arange(n), skip[i]) if skip[i] >= 0 else np.arange(n), queries[i], 0)
            return
        for share in SHARES:
            q = queries[left]
            ends = q[:, None, :] * self.top, q[:, None, :] * self.bottom
            impact = np.maximum(*ends)
            low = np.minimum(*ends).min(axis=1, keepdims=True)
            impact -= low  # counted from the lowest of each dimension, so never negative
            taken = impact >= -np.partition(-impact.reshape(len(q), -1), int(share * impact[0].size) - 1, axis=1)[:, int(share * impact[0].size) - 1][:, None, None]
            rest = np.where(taken, 0, impact).max(axis=1, keepdims=True)
            weights = np.where(taken, impact, rest)
            bound = self._sums(weights.transpose(0, 2, 1).reshape(len(q), -1).astype(np.float32))
            slack = 2 * (dims + 2) * np.finfo(np.float32).eps * weights.max(axis=1).sum(axis=1)  # rounding of the sums
            own = np.flatnonzero(skip[left] >= 0)
            bound[own, skip[left][own]] = -np.inf
            likely = np.argpartition(bound, n - k, axis=1)[:, n - k :]
            proven = np.einsum("ikd,id->ik", self.vectors[likely], q).min(axis=1)
            # a bound that is not a number keeps its row
            members = ~(bound < (proven - low.sum(axis=(1, 2)) - slack)[:, None])
            members[own, skip[left][own]] = False
            done = (members.sum(axis=1) <= max(4 * k, n // 4)) | (share == SHARES[-1])
            for i in np.flatnonzero(done):
                found[left[i]] = self._exact(np.flatnonzero(members[i]), q[i], int(taken[i].sum()))
            left = left[~done]
            if not len(left):
                return

    def _sums(self, weights: np.ndarray) -> np.ndarray:
        """Per query and row the sum of the weights of the row's segments, in slices of rows of bounded size."""
        n, dims = self.vectors.shape
        out = np.empty((len(weights), n), np.float32)
        rows = max(1, CELLS // weights.shape[1])
        for a in range(0, n, rows):
            part = self.segment[a : a + rows]
            member = np.zeros((weights.shape[1], len(part)), np.float32)
            member[part, np.arange(len(part))[:, None]] = 1
            np.matmul(weights, member, out=out[:, a : a + rows])
        return out

    def _exact(self, rows: np.ndarray, q: np.ndarray, read: int) -> tuple[np.ndarray, np.ndarray, int]:
        return rows, self.vectors[rows] @ q, read


def _stack(rows: pa.Array, dims: int) -> np.ndarray:
    """Vectors as a matrix of `dims` columns, shorter ones padded with 0; what is longer is cut (the rest meets only padding)."""
    sizes, flat = np.diff(rows.offsets.to_numpy()), rows.flatten().to_numpy()
    out = np.zeros((len(rows), dims), np.int64)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, keep = np.repeat(np.arange(len(rows)), sizes), inside < dims
    out[row[keep], inside[keep]] = flat[keep]
    return out


def _search_shards(k: int):
    """For batches (shard, kind, vec_id, row, vec) sorted by shard and kind, vectors (0) before queries (1): each query's best in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, own_rows, vectors, index, place = None, [], [], [], None, {}
        for b in batches:
            kinds, shards = b.column(1).to_numpy(), b.column(0).to_numpy()
            ends = [*(np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), b.num_rows]
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                if start == end:
                    continue
                part = b.slice(start, end - start)
                if shards[start] != now:
                    now, ids, own_rows, vectors, index, place = shards[start], [], [], [], None, {}
                if kinds[start] == 0:
                    ids.append(part.column(2).to_numpy())
                    own_rows.append(part.column(3).to_numpy())
                    vectors.append(part.column(4))
                    continue
                if not ids:
                    continue  # queries of a shard without vectors
                if index is None:
                    ids = [np.concatenate(ids)]
                    dims = max(int(np.diff(v.offsets.to_numpy()).max()) for v in vectors)
                    index = ImpactIndex(np.vstack([_stack(v, dims) for v in vectors]))
                    place, vectors = {v: i for i, v in enumerate(np.concatenate(own_rows).tolist())}, []
                queries = part.column(3).to_pylist()
                own = np.array([place.get(q, -1) for q in queries])
                out: list[list] = [[], [], [], []]
                for qid, q, (rows, scores, _) in zip(part.column(2).to_pylist(), queries, index.search_all(_stack(part.column(4), index.vectors.shape[1]), k, own), strict=True):
                    keep = np.lexsort((ids[0][rows], -scores))[:k]
                    out[0] += [qid] * len(keep)
                    out[1] += [q] * len(keep)
                    out[2] += ids[0][rows[keep]].tolist()
                    out[3] += scores[keep].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "row", "vec_id", "score"])

    return run


def quantise(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Rows (vec_id, row, vec array<long>) with floor(scale * x); vectors that are null or hold null, NaN or infinite values go.

    Rows equal in id and values count once; rows that share a vec_id with other
    values are rows of their own, told apart by `row`, a hash of both. A null
    vec_id goes.
    """
    v = project(vectors, vec_id="long", embedding="array<double>")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
    q = q.select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("vec"))
    return q.distinct().select("vec_id", F.xxhash64("vec_id", "vec").alias("row"), "vec")


def exact_topk(vectors: DataFrame, query_filter: str, k: int = 5, scale: int = 256, shard_rows: int = 32768) -> DataFrame:
    """The k best rows for each query row: (query_id, rank, vec_id, score).

    Queries are rows for which the SQL text `query_filter` over vec_id holds; a
    query row is not its own candidate. Ties go to the smaller vec_id; fewer than k
    candidates give all. Query rows that share a vec_id are ranked apart. Shorter vectors count as padded with 0. Empty tables
    give no rows; extra columns are not read. `shard_rows` bounds a shard, of
    which a task holds one at a time; each query visits every shard.
    """
    rows = quantise(vectors, scale)
    shards = max(1, -(-rows.count() // shard_rows))
    own = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    left = rows.select(own, F.lit(0).alias("kind"), "vec_id", "row", "vec")
    right = rows.filter(query_filter).select(every, F.lit(1).alias("kind"), "vec_id", "row", "vec")
    tagged = left.unionByName(right.select("shard", "kind", "vec_id", "row", "vec")).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "vec_id")
    found = tagged.mapInArrow(_search_shards(k), "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
