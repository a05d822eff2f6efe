"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprint bits that vary together are put into one partition, so that each
partition's values spread as little as the data allow and others as widely as
possible. Unequal thresholds t_p (t_p = -1: not probed) with
sum(t_p + 1) = max_distance + 1 are chosen by dynamic programming on estimated
candidate counts: two fingerprints within max_distance differ in at most t_p
bits of some partition p. One side of a link is indexed by its exact partition
value, the other probes all values within t_p, and every candidate is verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, project
from .components import connected_components

SEED = 42
#: Cost of one probed key against that of one verified candidate.
PROBE_COST, VERIFY_COST = 1.0, 0.5
_SLICE = 1 << 20


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash of a text; null or no words give 0.

    A-Z are lower-cased, words are runs of other than ASCII white space,
    shingles repeat as they occur; fewer words than a shingle are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _SLICE):
        part = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _SLICE], stops[at : at + _SLICE], strict=True)], dtype=">u8")
        # bytes of 0 and 1, added eight to a word; 255 rows cannot overflow a byte
        lanes = np.unpackbits(part.view(np.uint8)).view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fp long) for documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return project(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """The 64 x 64 counts of bits set together, over all fingerprints; the diagonal counts each bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(v, axis=1)[:, ::-1].astype(np.float32)
            total += bits.T @ bits
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total.ravel()[k].astype(np.int64))], ["k", "n"])

    out = np.zeros(64 * 64)
    for r in fps.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # 4096 rows at most
        out[r.k] = r.n
    return out.reshape(64, 64)


def group_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of equal size; a bit joins the open group it correlates with most."""
    p = np.diag(counts) / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(counts / max(n, 1) - np.outer(p, p)) / np.outer(var, var)
    np.fill_diagonal(corr, 0)
    size, left, groups = 64 // parts, set(range(64)), []
    for _ in range(parts - 1):
        seed = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            b = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(b)
            left.discard(b)
        groups.append(sorted(group))
    return [*groups, sorted(left)]


def ball(width: int, radius: int) -> int:
    total, term = 0, 1
    for k in range(radius + 1):
        total += term
        term = term * (width - k) // (k + 1)
    return total


def estimated_costs(counts: np.ndarray, n: int, group: list[int], most: int) -> list[float]:
    """Cost of probing one partition at t = -1 .. most, from the share of pairs expected within t there."""
    p = np.diag(counts)[group] / max(n, 1)
    within = np.zeros(len(group) + 1)
    within[0] = 1
    for x in 2 * p * (1 - p):  # the distance of two fingerprints as a sum of independent bits
        within[1:] = within[1:] * (1 - x) + within[:-1] * x
        within[0] *= 1 - x
    near = np.cumsum(within)
    return [0.0] + [n * PROBE_COST * (ball(len(group), t) + 1) + VERIFY_COST * n * n * float(near[t]) for t in range(most + 1)]


def allocate(costs: list[list[float]], max_distance: int) -> tuple[float, list[int]]:
    """The cheapest thresholds with sum(t + 1) = max_distance + 1, by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, max_distance - used + 1):
                now = (cost + row[t + 1], [*ts, t])
                if used + t + 1 not in step or now < step[used + t + 1]:
                    step[used + t + 1] = now
        best = step
    return best[max_distance + 1]


def plan(counts: np.ndarray, n: int, max_distance: int, parts: tuple[int, ...] = (1, 2, 3, 4, 6, 8)) -> list[tuple[list[int], int]]:
    """The partitions to probe, each with its threshold: the cheapest over the given numbers of partitions."""
    options = []
    for m in parts:
        groups = group_bits(counts, n, m)
        cost, ts = allocate([estimated_costs(counts, n, g, max_distance) for g in groups], max_distance)
        options.append((cost, m, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(options)[2]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _probes(part: int, value: Column, near: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, near)), lambda x: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(x).alias("key")))


def links(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """Rows (u, v), u < v: all pairs of distinct fingerprints (column fp, one row each) that differ in at most `max_distance` bits."""
    n = fps.count()
    chosen = plan(bit_counts(fps), n, max_distance)
    exact, probe = [], []
    for k, (group, t) in enumerate(chosen):
        mask = sum(1 << b for b in group)
        near = [_signed(sum(1 << b for b in c)) for r in range(t + 1) for c in itertools.combinations(group, r)]
        value = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        exact.append(F.struct(F.lit(k).alias("part"), value.alias("key")))
        probe.append(_probes(k, value, near))
    left = fps.select(F.col("fp").alias("u"), F.explode(F.array(*exact)).alias("s")).select("u", "s.part", "s.key")
    right = fps.select(F.col("fp").alias("v"), F.explode(F.concat(*probe)).alias("s")).select("v", "s.part", "s.key")
    near = left.join(right, ["part", "key"]).filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_distance))
    return near.select("u", "v").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each input row.

    Equal fingerprints are collapsed to one before the search, so copies make
    no pairs. component_id is the smallest doc_id reachable over links.
    Null or wordless texts have fingerprint 0 and link like any other. Rows
    that repeat, or share a doc_id, stay rows. Null doc_ids stay null and name
    no component unless nothing else is reachable (component_id null then). An
    empty table gives no rows; other columns are not read.
    """
    all_fps = materialize(fingerprints(docs, shingle), "simhash")
    distinct = materialize(all_fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    parts = connected_components(links(distinct.select("fp"), max_distance))
    grouped = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = grouped.select("fp", "component").join(least, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return all_fps.join(by_fp, "fp").select("doc_id", hexed, "component_id")
