"""Near copies by word shingles: pairs are proposed without loss, exact Jaccard similarity decides.

Two ways propose pairs. First SimHash with the generalised pigeonhole of
`simhash`: correlated bits share a partition, dynamic programming allots each a
threshold, and every text probes the partitions' values within it. A value has
a few leaders, and a text goes only to the closest that it meets, so that a
group of any size makes as many pairs as it has texts. This links most copies
but proves nothing. Then each text's first shingles, in one order of all
shingles with common ones last, are joined: of two similar texts with those
prefixes at least one shingle is in both, so every similar pair of texts not
linked yet is proposed. While a shingle still unites many texts that are not
linked, they too meet a leader before they meet each other.

Proposed pairs whose parity sketches differ in more bits than similar sets can
are dropped, which leaves out no similar pair; the others' texts are compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, project
from .components import connected_components
from .simhash import _signed, bit_counts, fingerprint, plan

#: Words in a shingle of the fingerprints that propose pairs.
PROPOSING = 2
#: Orders of texts, each of which gives every value of a partition one leader; leaders a text is compared with.
ORDERS, CLOSEST = 3, 2
#: Texts meet leaders of their shingles once, and again as long as comparing all would take CROWDED times the shingles' entries and the last turn left LINKING of them at most.
CROWDED, LINKING = 4, 0.8
#: Shingles that stand in OFTEN of SAMPLE texts, the MOST commonest at most, come last in the prefixes; this bears on time only.
SAMPLE, OFTEN, MOST = 10_000, 3, 200_000
#: Bits of a parity sketch for each shingle, at least, and in all.
SKETCH, LEAST_BITS = 2, 256
#: Shared shingles that a text's entries carry, to tell at which of several a pair is proposed.
FIRST = 8
#: A sketch folded to its least width, as words of 64 bits.
WORDS = [f"w{k}" for k in range(LEAST_BITS // 64)]


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the different shingles; words as in `fingerprint`, fewer words are one shingle, none are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    grams = {digest(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))}
    return np.fromiter(grams, np.uint64, len(grams)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two arrays of different values; that of two empty ones is 0."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(len(a) + len(b) - common, 1)


def sketch(shingles: np.ndarray) -> bytes:
    """For each residue of the hashes, by a power of two, whether an odd number of shingles has it."""
    width = max(LEAST_BITS, 1 << max(SKETCH * len(shingles) - 1, 1).bit_length())
    return np.packbits(np.bincount(shingles & (width - 1), minlength=width) & 1).tobytes()


def folded(x: bytes, width: int) -> np.ndarray:
    """A sketch folded to `width` bits, as bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width // 8), axis=0)


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded: no more than shingles that only one of the sets has."""
    width = 8 * min(len(a), len(b))
    return int(np.bitwise_count(folded(a, width) ^ folded(b, width)).sum())


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """So many first shingles, rare ones before common ones, that any set as similar shares one of its own with them."""
    n = len(shingles)
    found = np.minimum(np.searchsorted(common, shingles), max(len(common) - 1, 0))
    often = common[found] == shingles if len(common) else np.zeros(n, bool)
    return shingles[np.lexsort((shingles, often))][: n - math.ceil(similarity * n - 1e-9) + 1] if n else shingles


def _texts(docs: DataFrame) -> DataFrame:
    """Rows (none, doc, hash, text): whether doc_id is null, doc_id or 0, a 128-bit hash of the text, the text or ''."""
    d = project(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc"), F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("hash"), "text")


def _common(texts: DataFrame, n: int, shingle: int) -> np.ndarray:
    """Shingles that many of a sample of different texts have, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle))], ["s"])

    share = max(1, n // SAMPLE)
    sample = texts.filter(F.pmod(F.xxhash64("hash"), F.lit(share)) == 0).dropDuplicates(["hash"]).select("text")
    s = sample.mapInArrow(run, "s long").groupBy("s").count()
    return np.sort(s.filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "s").limit(MOST).select("s").toArrow().column(0).to_numpy())


def _nodes(texts: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """A row for each different text: id, hash, its smallest (none, doc), copies, fp, and of its shingle set size, sketch, prefix."""
    common = texts.sparkSession.sparkContext.broadcast(_common(texts, texts.count(), shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["none", "doc", "hash", "fp", "size", "sketch", *WORDS, "prefix"]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [t.as_py() for t in part.column(3)]
                fps = np.fromiter((fingerprint(t, PROPOSING) for t in found), np.uint64, len(found))
                sets = [shingle_set(t, shingle) for t in found]
                first = pa.array([prefix(x, similarity, common.value) for x in sets], pa.list_(pa.int64()))
                sketches = [sketch(x) for x in sets]
                words = np.array([folded(x, LEAST_BITS) for x in sketches], np.uint8).view(np.int64)
                columns = [*part.columns[:3], fps.view(np.int64), np.array([len(x) for x in sets], np.int32), pa.array(sketches, pa.binary()), *words.T, first]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    rows = texts.mapInArrow(run, f"none boolean, doc long, hash binary, fp long, size int, sketch binary, {', '.join(f'{w} long' for w in WORDS)}, prefix array<long>")
    kept = [F.first(c).alias(c) for c in ("fp", "size", "sketch", *WORDS, "prefix")]
    nodes = rows.groupBy("hash").agg(F.min(F.struct("none", "doc")).alias("m"), F.count("*").alias("copies"), *kept)
    return scratch.write(nodes.select(F.monotonically_increasing_id().alias("id"), "hash", "m.none", "m.doc", "copies", "fp", "size", "sketch", *WORDS, "prefix"), "nodes")


def _bits(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _sizes(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6


def _values_near(part: int, value: Column, near: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, near)), lambda x: F.xxhash64(F.lit(part), value.bitwiseXOR(x)))


def _probed(nodes: DataFrame, similarity: float, max_distance: int, reach: int) -> DataFrame:
    """Rows (u, v): every text with the closest of the leaders whose partition values it probes.

    A value's leaders are its first texts in ORDERS orders; in the first of
    these the texts with most copies lead.
    """
    chosen = plan(bit_counts(nodes), max(nodes.count(), 1), max_distance, parts=(4, 6, 8))  # fewer parts would need wide balls
    exact, probe = [], []
    for k, (group, t) in enumerate(chosen):
        near = [_signed(sum(1 << b for b in c)) for r in range(t + 1) for c in itertools.combinations(group, r)]
        value = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in group))))
        exact.append(F.xxhash64(F.lit(k), value))
        probe.append(_values_near(k, value, near))
    some = nodes.filter("size > 0")
    filed = some.select(F.explode(F.array(*exact)).alias("key"), F.col("id").alias("v"), F.col("fp").alias("fp_v"), F.col("size").alias("size_v"), "copies")
    one = F.struct("v", "fp_v", "size_v")
    orders = [F.struct(-F.col("copies"), F.xxhash64("v")), *[F.xxhash64("v", F.lit(k)) for k in range(1, ORDERS)]]
    leaders = filed.groupBy("key").agg(*[F.min_by(one, o).alias(f"l{k}") for k, o in enumerate(orders)])
    leaders = leaders.select("key", F.array_distinct(F.array(*[f"l{k}" for k in range(ORDERS)])).alias("leaders"))
    probes = some.select("id", "fp", "size", F.explode(F.concat(*probe)).alias("key"))
    close = F.filter("leaders", lambda x: (x.v != F.col("id")) & (F.bit_count(x.fp_v.bitwiseXOR(F.col("fp"))) <= reach) & (F.least(x.size_v, F.col("size")) >= similarity * F.greatest(x.size_v, F.col("size")) - 1e-6))
    met = probes.join(leaders, "key").select("id", F.transform(close, lambda x: F.struct(F.bit_count(x.fp_v.bitwiseXOR(F.col("fp"))).alias("d"), x.v.alias("v"))).alias("met")).filter(F.size("met") > 0)
    # a text meets no more leaders than it has probes
    best = met.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("met")))), 1, CLOSEST).alias("best"))
    pairs = best.select("id", F.explode("best.v").alias("v"))
    return pairs.select(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v")).distinct()


def _shared(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries (s, id, label, size, at) of shingles whose texts have different labels."""
    return _divided(nodes.join(labels, "id").select("id", "label", "size", F.posexplode("prefix").alias("at", "s")))


def _crowd(shared: DataFrame) -> tuple[int, int]:
    """How many entries there are, and pairs of them that share a shingle."""
    entries, pairs = shared.groupBy("s").count().agg(F.sum("count"), F.sum(F.expr("count * (count - 1) / 2"))).first()
    return entries or 0, pairs or 0


def _carrying(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries with their text's folded sketch and its first shared shingles."""
    first = entries.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("s")), 1, FIRST).alias("first"))  # a text's own prefix
    return entries.join(nodes.select("id", *WORDS).join(first, "id"), "id")


def _divided(entries: DataFrame) -> DataFrame:
    of = Window.partitionBy("s")
    found = entries.withColumn("_a", F.min("label").over(of)).withColumn("_b", F.max("label").over(of))
    return found.filter("_a < _b").drop("_a", "_b")


def _can_be_similar(similarity: float) -> Column:
    """For entries u and v of one shingle: different labels, sizes that fit, and room for enough shingles up to this one and after it."""
    total = F.col("size_u") + F.col("size_v")
    most = F.least("at_u", "at_v") + F.least(F.col("size_u") - F.col("at_u"), F.col("size_v") - F.col("at_v"))
    enough = most >= similarity / (1 + similarity) * total - 1e-6
    return (F.col("label_u") != F.col("label_v")) & _sizes("size_u", "size_v", similarity) & enough


def _proposed_here(similarity: float) -> Column:
    """For carrying entries: sketches that agree enough, and no other shingle to propose the pair.

    Of several shingles that two texts share, the least that both carry proposes
    them; if they carry none in common, each does.
    """
    apart = sum((_bits(f"{w}_u", f"{w}_v") for w in WORDS), F.lit(0))
    close = apart <= (1 - similarity) / (1 + similarity) * (F.col("size_u") + F.col("size_v")) + 1e-6
    return close & F.coalesce(F.array_min(F.array_intersect("first_u", "first_v")) == F.col("s"), F.lit(True))


_ENTRY = ("id", "label", "size", "at")


def _side(entries: DataFrame, side: str, *more: str) -> DataFrame:
    return entries.select("s", *[F.col(c).alias(f"{c}_{side}") for c in (*_ENTRY, *more)])


def _with_leaders(shared: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Rows (u, v): every entry's text with its shingle's leader, another one each turn."""
    one = F.struct(*[F.col(c).alias(f"{c}_v") for c in _ENTRY])
    leaders = shared.groupBy("s").agg(F.min_by(one, F.xxhash64("id", F.lit(turn))).alias("l")).select("s", "l.*")
    pairs = _side(shared, "u").join(leaders, "s").filter(_can_be_similar(similarity))
    return pairs.select(F.greatest("id_u", "id_v").alias("u"), F.least("id_u", "id_v").alias("v")).distinct()


def _all_pairs(carrying: DataFrame, similarity: float) -> DataFrame:
    """Rows (u, v): all pairs of a shingle's entries that can be similar."""
    u, v = (_side(carrying, side, "first", *WORDS) for side in "uv")
    pairs = u.join(v, "s").filter((F.col("id_u") > F.col("id_v")) & _can_be_similar(similarity) & _proposed_here(similarity))
    return pairs.select(F.col("id_u").alias("u"), F.col("id_v").alias("v")).distinct()


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> tuple[DataFrame, int]:
    """The pairs (u, v) whose texts have the similarity, written, and how many they are."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            limit = (b.column(3).to_numpy() + b.column(5).to_numpy().astype(np.int64)) * (1 - similarity) / (1 + similarity) + 1e-6
            apart = [sketch_distance(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)]
            keep = pa.array(np.array(apart, np.float64) <= limit)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    side = lambda c: nodes.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("size").alias(f"size_{c}"))
    sketched = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "sketch_u", "size_u", "sketch_v", "size_v")
    tested = scratch.write(sketched.mapInArrow(possible, "u long, v long"), "tested")

    # one row of each text in question: the row that its node names
    ends = tested.select(F.col("u").alias("id")).union(tested.select("v")).distinct()
    place = nodes.select("id", "hash", "none", "doc").join(ends, "id")
    found = texts.join(place, ["none", "doc", "hash"]).groupBy("none", "doc", "hash").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    found = scratch.write(found.select("id", "text"), "texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}  # sets of a few texts that were met last

        def of(key: int, text: pa.StringScalar) -> np.ndarray:
            if key not in kept:
                if len(kept) >= 64:
                    del kept[next(iter(kept))]
                kept[key] = shingle_set(text.as_py(), shingle)
            return kept[key]

        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)
            keep = pa.array([jaccard(of(u, a), of(v, t)) >= similarity for u, v, a, t in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    both = tested.join(found.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u").join(found.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v")
    similar = scratch.write(both.select("u", "v", "text_u", "text_v").mapInArrow(compare, "u long, v long"), "similar")
    scratch.drop("texts", "tested")
    return similar, similar.count()


def _labels(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (id, label): the component of the links that a text is in, else its own id."""
    parts = connected_components(links, scratch).withColumnRenamed("node", "id")
    out = scratch.write(nodes.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("label")), "labels")
    scratch.drop("links")
    return out


def _grouped(docs: DataFrame, shingle: int, similarity: float, max_distance: int = 7, reach: int = 13) -> tuple[DataFrame, DataFrame]:
    """Rows (none, doc, hash, text) of the input, and (hash, none, doc, label) of the different texts."""
    scratch = Scratch(docs.sparkSession, "near-copies")
    texts = _texts(docs)
    nodes = _nodes(texts, shingle, similarity, scratch)

    links, _ = _similar(_probed(nodes, similarity, max_distance, reach), nodes, texts, shingle, similarity, scratch)
    links = scratch.write(links, "all-links")
    labels = _labels(nodes, links, scratch)
    shared = scratch.write(_shared(nodes, labels), "shared")
    turn, (entries, pairs) = 0, _crowd(shared)
    while entries:
        similar, n = _similar(_with_leaders(shared, turn, similarity), nodes, texts, shingle, similarity, scratch)
        if n:
            links = scratch.write(links.select("u", "v").union(similar), "all-links")
            labels = _labels(nodes, links, scratch)
            shared = scratch.write(_divided(shared.drop("label").join(labels, "id")), "shared")
        turn, before, (entries, pairs) = turn + 1, entries, _crowd(shared)
        if pairs <= CROWDED * entries or entries > LINKING * before:
            break
    similar, n = _similar(_all_pairs(_carrying(shared, nodes), similarity), nodes, texts, shingle, similarity, scratch)
    if n:
        labels = _labels(nodes, links.select("u", "v").union(similar), scratch)
    scratch.drop("shared", "similar")
    grouped = scratch.write(nodes.select("id", "hash", "none", "doc").join(labels, "id").select("hash", "none", "doc", "label"), "grouped")
    scratch.drop("nodes", "labels", "all-links")
    return texts, grouped


def near_copy_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_distance: int = 7, reach: int = 13) -> DataFrame:
    """Rows (doc_id, component_id), one for each input row: groups linked by Jaccard similarity of word shingles.

    Equal texts are one before the search (by a 128-bit hash). component_id is
    the smallest doc_id reachable. Null, empty and wordless texts are alike
    only if equal, null counting as empty; texts shorter than a shingle are
    one shingle. Repeated rows stay rows; null doc_ids name no component
    unless nothing else is reachable (null then). An empty table gives no
    rows; other columns are not read. `max_distance` and `reach` (bits of
    fingerprints) bear on time only.
    """
    texts, grouped = _grouped(docs, shingle, similarity, max_distance, reach)
    least = grouped.groupBy("label").agg(F.min(F.when(~F.col("none"), F.col("doc"))).alias("component_id"))
    found = grouped.select("hash", "label").join(least, "label").select("hash", "component_id")
    return texts.select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "hash").join(found, "hash").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, all columns as they are, that stand for their group: one row for each.

    It is the row with the smallest doc_id, those without one coming last, and
    of several texts with that doc_id the one with the smallest hash. Rows that
    share a doc_id but hold different texts are different documents.
    """
    texts, grouped = _grouped(docs, shingle, similarity)
    first = F.min(F.struct("none", "doc", "hash")).alias("first")
    kept = grouped.groupBy("label").agg(first).select(F.col("first.none").alias("_none"), F.col("first.doc").alias("_doc"), F.col("first.hash").alias("_hash"))
    names = docs.columns
    numbered = docs.toDF(*[f"_in{i}" for i in range(len(names))])
    column = lambda name, kind: (F.col(f"_in{names.index(name)}") if name in names else F.lit(None)).cast(kind)
    keyed = numbered.select("*", column("doc_id", "long").isNull().alias("_none"), F.coalesce(column("doc_id", "long"), F.lit(0)).alias("_doc"), F.unhex(F.md5(F.encode(F.coalesce(column("text", "string"), F.lit("")), "UTF-8"))).alias("_hash"))
    rows = keyed.join(kept, ["_none", "_doc", "_hash"], "left_semi")
    if texts.groupBy("none", "doc", "hash").count().filter("count > 1").limit(1).count():  # else no row repeats, and texts need not move again
        rows = rows.dropDuplicates(["_none", "_doc", "_hash"])
    return rows.drop("_none", "_doc", "_hash").toDF(*names)
