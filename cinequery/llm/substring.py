"""Substring dedup: matching statistics against compressed FM-indexes, one per shard.

A window of `window` words goes to the shard of its minimizer (the smallest
hash of its word triples), so equal windows meet in one shard and no document
is streamed against foreign shards. A run of windows with one minimizer travels
as one piece of text. A shard's pieces whose minimizer two or more different
pieces share are indexed and streamed through the index backwards; a window is
a repeat if its interval holds an earlier place. Equal pieces are read as a
stream, and only the earliest is kept and indexed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, project, text_bytes
from .fm_index import FMIndex, matching_statistics

GRAM = 3
RUN = 40  # windows in one piece at most; longer runs are cut
PIECE_BYTES_PER_SHARD = 24 << 20
INDEX_WORDS = 400_000  # words in one index at most, but for one minimizer's own pieces
_LAST = np.iinfo(np.int64).max  # null doc_ids come after all others


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same minimizer: (first window, windows, minimizer, whether it occurs again in the text)."""
    grams = _mix(hashes[:-2] * np.uint64(3) + _mix(hashes[1:-1]) * np.uint64(5) + _mix(_mix(hashes[2:])) * np.uint64(7))
    width, low, have = window - GRAM + 1, grams, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(low)))
    if len(sizes) and sizes.max() > RUN:
        parts = -(-sizes // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + nth * RUN
        sizes = np.minimum(np.repeat(sizes, parts) - nth * RUN, RUN)
    keys = low[starts]
    values, counts = np.unique(grams, return_counts=True)
    return starts, sizes, keys, counts[np.searchsorted(values, keys)] > 1


_HEAD = np.dtype([("doc", "<i8"), ("hash", "<u8"), ("start", "<i4"), ("size", "<i4"), ("bytes", "<i4"), ("key", "<u4"), ("again", "?")])


def _pack(heads: list[tuple], pieces: list[bytes], press: zstandard.ZstdCompressor) -> bytes:
    head = np.array(heads, _HEAD)
    columns = b"".join(head[name].tobytes() for name in _HEAD.names)
    return len(head).to_bytes(4, "little") + press.compress(columns + b"".join(pieces))


def _unpack(blob: bytes, press: zstandard.ZstdDecompressor) -> tuple[np.ndarray, bytes]:
    n, raw, at = int.from_bytes(blob[:4], "little"), press.decompress(blob[4:]), 0
    head = np.empty(n, _HEAD)
    for name in _HEAD.names:
        size = n * _HEAD[name].itemsize
        head[name] = np.frombuffer(raw[at : at + size], _HEAD[name])
        at += size
    return head, raw[at:]


def pieces(docs: DataFrame, window: int, shards: int) -> DataFrame:
    """Rows (shard, blob): pieces of documents, packed and compressed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, known, held, size = zstandard.ZstdCompressor(level=3), {}, {}, 0

        def flush() -> pa.RecordBatch:
            keys = list(held)
            blobs = [_pack(*held[k], press) for k in keys]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                words = _words(text)
                if len(words) < window:
                    continue
                if len(known) > 1_000_000:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w)
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                starts, sizes, keys, again = _runs(hashes, window)
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                begin = np.concatenate([[0], ends + 1])[starts].tolist()
                stop = ends[starts + sizes + window - 2].tolist()
                whole, doc = xxhash.xxh3_64_intdigest(joined), _LAST if doc is None else doc
                mixed = _mix(keys)
                for shard, s, z, a, e, key, twice in zip((mixed % np.uint64(shards)).tolist(), starts.tolist(), sizes.tolist(), begin, stop, (mixed >> np.uint64(32)).tolist(), again.tolist(), strict=True):
                    heads, texts = held.get(shard) or held.setdefault(shard, ([], []))
                    heads.append((doc, whole, s, z, e - a, key, twice))
                    texts.append(joined[a:e])
                size += 3 * len(joined)
                if size > 48 << 20:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return project(docs, doc_id="long", text="string").mapInArrow(run, "shard int, blob binary")


class _Repeats:
    """Collects (doc, hash, start, mask of repeated windows) rows."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, doc: int, whole: int, start: int, mask: int) -> None:
        self.rows.append((doc, whole, start, mask))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = np.array(self.rows, np.dtype([("doc", "<i8"), ("hash", "<u8"), ("start", "<i4"), ("mask", "<u8")])), []
        return pa.RecordBatch.from_arrays([pa.array(rows["doc"]), pa.array(rows["hash"].view(np.int64)), pa.array(rows["start"]), pa.array(rows["mask"].view(np.int64))], ["doc", "hash", "start", "mask"])


def _index_pieces(group: list[tuple[bytes, tuple]], window: int, out: _Repeats) -> None:
    """Finds repeated windows among different pieces; each is (text, (doc, start, hash, windows))."""
    group.sort(key=lambda x: (x[1][0], x[1][1]))
    ids: dict[bytes, int] = {}
    codes, lengths = [], []
    for text, _ in group:
        words = text.split(b" ")
        codes += [ids.setdefault(w, len(ids) + 1) for w in words]
        codes.append(0)
        lengths.append(len(words))
    text, lengths = np.array(codes, np.int64), np.array(lengths, np.int64)
    ends = np.cumsum(lengths + 1) - 1
    _, first = matching_statistics(FMIndex(text, window), text, ends, lengths)
    owner = np.repeat(np.arange(len(group)), lengths + 1)
    inside = np.arange(len(text)) - np.repeat(ends - lengths, lengths + 1)
    at = np.flatnonzero((first >= 0) & (first < np.arange(len(text))))
    # an equal place is no earlier one: rows that repeat a doc_id and start are the same place
    place = np.array([(m[0], m[1]) for _, m in group], np.int64)
    mine, theirs = owner[at], owner[first[at]]
    docs, other = place[mine, 0], place[theirs, 0]
    earlier = (other < docs) | ((other == docs) & (place[theirs, 1] + inside[first[at]] < place[mine, 1] + inside[at]))
    masks: dict[int, int] = {}
    for k, bit in zip(mine[earlier].tolist(), inside[at][earlier].tolist(), strict=True):
        masks[k] = masks.get(k, 0) | 1 << bit
    for k, mask in masks.items():
        doc, start, whole, _ = group[k][1]
        out.add(doc, whole, start, mask)


def repeats(blobs: DataFrame, window: int) -> DataFrame:
    """Rows (doc, hash, start, mask): windows start + i, for each bit i of mask, that also start earlier.

    `blobs` (shard, blob) come with a shard's rows side by side; what a shard
    held is let go as the next one begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, out, pieces, now = zstandard.ZstdDecompressor(), _Repeats(), _Pieces(), None
        for b in batches:
            for shard, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if shard != now and now is not None:
                    yield from pieces.close(window, out)
                    pieces = _Pieces()
                now = shard
                pieces.add(*_unpack(blob.as_py(), press), out)
                if len(out.rows) > 50_000:
                    yield out.batch()
        yield from pieces.close(window, out)

    return blobs.mapInArrow(run, "doc long, hash long, start int, mask long")


class _Pieces:
    """A shard's different pieces, each at its earliest place."""

    def __init__(self):
        self.least: dict[bytes, tuple] = {}
        self.keys: dict[bytes, int] = {}
        self.inner: set[bytes] = set()  # may repeat a window within itself

    def add(self, head: np.ndarray, raw: bytes, out: _Repeats) -> None:
        least, at = self.least, 0
        for doc, whole, start, size, length, key, twice in head.tolist():
            piece = raw[at : at + length]
            at += length
            now, was = (doc, start, whole, size), least.get(piece)
            if was is None:
                least[piece], self.keys[piece] = now, key
                if twice:
                    self.inner.add(piece)
                continue
            if now[:2] < was[:2]:
                least[piece], now = now, was
            if now[:2] != least[piece][:2]:
                out.add(now[0], now[2], now[1], (1 << now[3]) - 1)

    def close(self, window: int, out: _Repeats) -> Iterator[pa.RecordBatch]:
        """Finds what different pieces share, minimizer by minimizer, in indexes of bounded size."""
        counts: dict[int, int] = {}
        for key in self.keys.values():
            counts[key] = counts.get(key, 0) + 1
        shared = sorted((self.keys[p], p) for p in self.least if counts[self.keys[p]] > 1 or p in self.inner)
        group: list[tuple[bytes, tuple]] = []
        words, last = 0, None
        for key, p in shared:
            if key != last and words > INDEX_WORDS:
                _index_pieces(group, window, out)
                group, words = [], 0
                yield out.batch()
            last = key
            group.append((p, self.least[p]))
            words += self.least[p][3] + window
        if group:
            _index_pieces(group, window, out)
        yield out.batch()


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_text): each document without the words of repeated windows.

    A word goes if a run of `window` words over it also starts earlier: in a
    smaller doc_id, or earlier in the same document. Windows are judged on the
    input. Words are runs of other than ASCII white space; kept words are
    joined by one space. Null and short texts lose nothing (null: no words).
    Null doc_ids come after all others; rows that share a doc_id count as one
    document, so equal places are not earlier. One row for each input row;
    empty tables give none; other columns are not read.
    """
    if not GRAM <= window:
        raise ValueError(f"window must be {GRAM} or more")
    docs = project(docs, doc_id="long", text="string")
    shards = max(8, -(-3 * text_bytes(docs) // PIECE_BYTES_PER_SHARD)) * 2
    # a partition a shard: memory is bounded by shards, whatever their number
    found = repeats(pieces(docs, window, shards).repartition(shards, "shard").sortWithinPartitions("shard"), window)
    found = materialize(found, "repeats")
    by_doc = found.groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wholes = [xxhash.xxh3_64_intdigest(b" ".join(_words(t.as_py()))) for t in b.column(1)]
            key = pa.array(np.array(wholes, np.uint64).view(np.int64))
            doc = b.column(0).fill_null(int(_LAST))
            yield pa.RecordBatch.from_arrays([doc, key, b.column(0), b.column(1)], ["doc", "hash", "doc_id", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, marks in zip(b.column(1), b.column(2), strict=True):
                words, marks = _words(text.as_py()), marks.as_py()
                n_words.append(len(words))
                if marks:
                    change = np.zeros(len(words) + 1, np.int64)
                    for m in marks:
                        bits = np.flatnonzero(np.unpackbits(np.array([m["mask"]], "<i8").view(np.uint8), bitorder="little")) + m["start"]
                        np.add.at(change, bits, 1)
                        np.add.at(change, bits + window, -1)
                    words = [w for w, c in zip(words, np.cumsum(change)[:-1].tolist(), strict=True) if not c]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    keyed = docs.mapInArrow(hashed, "doc long, hash long, doc_id long, text string")
    return keyed.join(by_doc, ["doc", "hash"], "left").select("doc_id", "text", "marks").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def kept_digest(found: DataFrame) -> DataFrame:
    """The kept text as a SHA-256 digest of its UTF-8 bytes."""
    return found.withColumn("kept_sha256", F.sha2(F.encode("kept_text", "UTF-8"), 256)).drop("kept_text")


def brute_force(rows: list[tuple[int, str | None]], window: int = 20) -> list[tuple[int, int, int, str]]:
    """What `substring_dedup` must return for distinct doc_ids, window by window (tests)."""
    first: dict[tuple, tuple] = {}
    split = {d: _words(t) for d, t in rows}
    for d in sorted(split):
        for i in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][i : i + window]), (d, i))
    out = []
    for d, words in split.items():
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
