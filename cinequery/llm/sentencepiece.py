"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

White space is written as U+2581, with one such mark put in front of a text; a
character that no piece covers falls back to its UTF-8 bytes. A literal U+2581
is kept apart from white space by its bytes, so that decoding restores every
text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import project

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Fixed numbers of the model format's piece types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0  # fixed: an unknown character scores this much below the worst piece
CACHE = 300_000  # chunks remembered by a worker, at most
SHORT = 64  # characters; longer chunks are cut or segmented alone, and not remembered
BLOCK = 1 << 15  # chunks looked up at once
TOGETHER = 400_000  # characters of texts that are split into chunks before these are looked up
LATTICE = 100_000  # characters of the lattices that grow together, which bounds their arrays
_STOP = b"\xff"  # in no UTF-8 text, so in no piece


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = raw[at : at + 8], at + 8
        elif kind == 5:
            value, at = raw[at : at + 4], at + 4
        else:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def read_model(raw: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file's pieces, by id."""
    pieces = []
    for number, value in _fields(raw):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
    return pieces


def _groups(texts: list[str | None], size: int) -> Iterator[list[str | None]]:
    """The texts in order, in groups that end once they hold more than `size` characters."""
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text or "")
        if held > size:
            yield group
            group, held = [], 0
    if group:
        yield group


class DoubleArray:
    """A trie over bytes in two arrays: the child of s by byte c is base[s] + c if check there is s. Byte 0 ends a key and holds its value."""

    def __init__(self, keys: list[bytes], values: list[int]):
        pairs = sorted(zip(keys, values, strict=True))
        self.base, self.check = [0] * 1024, [-1] * 1024
        self.check[0] = 0
        self._free = 1
        todo = [(0, 0, len(pairs), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            groups, value = [], None
            while lo < hi:
                key = pairs[lo][0]
                if len(key) == depth:
                    value, lo = pairs[lo][1], lo + 1
                    continue
                c, end = key[depth], lo
                while end < hi and pairs[end][0][depth] == c:
                    end += 1
                groups.append((c + 1, lo, end))
                lo = end
            codes = [0] * (value is not None) + [c for c, _, _ in groups]
            base = self._place(codes)
            self.base[state] = base
            for c in codes:
                self.check[base + c] = state
            if value is not None:
                self.base[base] = -value - 1
            todo += [(base + c, a, b, depth + 1) for c, a, b in groups]

    def _place(self, codes: list[int]) -> int:
        """The first base at which all codes find free slots."""
        while self.check[self._free] != -1:
            self._free += 1
            self._grow(self._free)
        base = max(1, self._free - codes[0])
        while True:
            self._grow(base + codes[-1])
            if all(self.check[base + c] == -1 for c in codes):
                return base
            base += 1

    def _grow(self, at: int) -> None:
        if at >= len(self.base):
            more = max(len(self.base), at + 1)
            self.base += [0] * more
            self.check += [-1] * more

    def prefixes(self, text: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every key that starts at `at`."""
        base, check, state, n = self.base, self.check, 0, len(self.base)
        for i in range(at, len(text)):
            to = base[state] + text[i] + 1
            if to >= n or check[to] != state:
                return
            state = to
            end = base[state]
            if end < n and check[end] == state and base[end] < 0:
                yield i + 1, -base[end] - 1


class Tokenizer:
    """Encodes and decodes with the pieces of a model file (its bytes); scores are taken as they are."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.pieces = read_model(raw)
        usable = [(p.encode(), i) for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)]
        self.trie = DoubleArray([p for p, _ in usable], [i for _, i in usable])
        self.scores = [s for _, s, _ in self.pieces]
        self.unknown_score = min([s for _, s, kind in self.pieces if kind == NORMAL], default=0.0) - UNKNOWN_PENALTY
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        self.byte_ids = [self.unknown] * 256
        self.written: list[bytes] = []
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
                self.written.append(bytes([int(p[3:5], 16)]))
            elif kind == UNKNOWN:
                self.written.append(" ⁇ ".encode())
            elif kind == CONTROL:
                self.written.append(b"")
            else:
                self.written.append(p.replace(MARK, " ").encode())
        # a text may be cut where no piece reaches across
        self.cuttable = all(MARK not in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED))
        self.together = {p[i : i + 2] for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED) for i in range(len(p) - 1)}
        # for many parts at once: the trie as arrays, with room to step past its end, and the piece that ends at a state
        base, check = np.array(self.trie.base), np.array(self.trie.check)
        leaf = np.clip(base, 0, len(base) - 1)
        self.leaf = np.where((base > 0) & (check[leaf] == np.arange(len(base))) & (base[leaf] < 0), -base[leaf] - 1, -1)
        self.step, self.owner = base, np.concatenate([check, np.full(max(0, int(base.max())) + 258, -1)])
        self.gains = np.array([*self.scores, self.unknown_score])  # piece -1 is an unknown character
        self.bytes = np.array(self.byte_ids)
        # the empty chunk stands for a literal mark
        self.mark = {"": np.array([self.byte_ids[b] for b in MARK.encode()], "<i4").tobytes()}
        self.cache: dict[str, bytes] = dict(self.mark)

    def viterbi(self, text: str) -> list[int]:
        """Ids of the segmentation with the highest sum of scores; of equal ones, that with the longest last piece."""
        raw = text.encode("utf-8", "surrogatepass")
        n = len(raw)
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        best[0] = 0.0
        scores, base, check, limit = self.scores, self.trie.base, self.trie.check, len(self.trie.base)
        at = 0
        while at < n:
            lead = raw[at]
            one = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, single = best[at], False
            state, end = 0, at
            # the trie's walk of `prefixes`, without a generator in the innermost loop
            while end < n:
                to = base[state] + raw[end] + 1
                if to >= limit or check[to] != state:
                    break
                state = to
                end += 1
                leaf = base[state]
                if leaf < limit and check[leaf] == state and base[leaf] < 0:
                    i = -base[leaf] - 1
                    score = here + scores[i]
                    if best[end] is None or score > best[end]:
                        best[end], back[end] = score, (at, i)
                    single = single or end == one
            if not single:
                score = here + self.unknown_score
                if best[one] is None or score > best[one]:
                    best[one], back[one] = score, (at, -1)
            at = one
        out: list[int] = []
        at = n
        while at:
            start, i = back[at]
            out += [self.byte_ids[b] for b in reversed(raw[start:at])] if i < 0 else [i]
            at = start
        return out[::-1]

    def lattices(self, parts: list[str]) -> list[bytes]:
        """Ids as bytes of short parts, the same as `viterbi` gives: every part's lattice grows by one position in a step."""
        raw = np.frombuffer(b"".join(p.encode("utf-8", "surrogatepass") + _STOP for p in parts), np.uint8)
        stops = np.flatnonzero(raw == _STOP[0])
        firsts = np.concatenate([[0], stops[:-1] + 1])
        within = (np.arange(len(raw)) - np.repeat(firsts, stops - firsts + 1)).astype(np.uint16)
        heads = np.flatnonzero((raw & 0xC0 != 0x80) & (raw != _STOP[0]))
        lead = raw[heads]
        one = np.zeros(len(raw), np.int64)
        one[heads] = heads + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        # edges of the lattices: the trie is walked from all characters at once, a byte in a step
        codes = raw + np.int64(1)
        lone = np.zeros(len(raw), bool)
        lone[heads] = True
        starts, ends, pieces = [], [], []
        at, state, far = heads, np.zeros(len(heads), np.int64), 0
        while len(at):
            to = self.step[state] + codes[at + far]
            ok = self.owner[to] == state
            at, state, far = at[ok], to[ok], far + 1
            piece = self.leaf[state]
            hit = np.flatnonzero(piece >= 0)
            start = at[hit]
            end = start + far
            lone[start[one[start] == end]] = False
            starts.append(start), ends.append(end), pieces.append(piece[hit])
        alone = np.flatnonzero(lone)
        start, end, piece = (np.concatenate(x) for x in ([*starts, alone], [*ends, one[alone]], [*pieces, np.full(len(alone), -1)]))
        order = np.argsort(within[start], kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        gain = self.gains[piece]
        # edges that start at the same distance end in different places; of equal sums the earlier start stays
        best, edge = np.full(len(raw), -np.inf), np.zeros(len(raw), np.int64)
        best[firsts] = 0.0
        for a, b in pairwise([0, *np.cumsum(np.bincount(within[start])).tolist()]):
            to, score = end[a:b], best[start[a:b]] + gain[a:b]
            up = np.flatnonzero(score > best[to])
            to = to[up]
            best[to], edge[to] = score[up], up + a
        chosen, at = np.zeros(len(raw), bool), stops
        while len(at):
            chosen[at] = True
            at = start[edge[at]]
            at = at[within[at] > 0]
        path = np.flatnonzero(chosen)
        taken = edge[path]
        piece, start = piece[taken], start[taken]
        width = np.where(piece < 0, path - start, 1)
        total = np.concatenate([[0], np.cumsum(width)])
        ids = np.repeat(piece, width)
        unknown = ids < 0
        if unknown.any():
            ids[unknown] = self.bytes[raw[(np.arange(len(ids)) + np.repeat(start - total[:-1], width))[unknown]]]
        blob = ids.astype("<i4").tobytes()
        return [blob[a:b] for a, b in pairwise([0, *(total[np.searchsorted(path, stops) + 1] * 4).tolist()])]

    def _long(self, chunk: str) -> bytes:
        """A long chunk's ids, cut where no piece reaches across."""
        cuts = [0, *(i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.together), len(chunk)]
        if len(cuts) == 2:
            return np.array(self.viterbi(chunk), "<i4").tobytes()
        return b"".join(self._ids([chunk[a:b] for a, b in pairwise(cuts)]))

    def _ids(self, chunks: list[str]) -> Iterator[bytes]:
        """Each chunk's ids as bytes. Those not remembered are segmented together."""
        for at in range(0, len(chunks), BLOCK):
            block = chunks[at : at + BLOCK]
            found = list(map(self.cache.get, block))
            missing = [k for k, ids in enumerate(found) if ids is None]
            new = {block[k] for k in missing}
            known = {c: self._long(c) for c in new if len(c) >= SHORT}
            short = [c for c in new if len(c) < SHORT]
            for parts in _groups(short, LATTICE):
                known.update(zip(parts, self.lattices(parts), strict=True))
            for k in missing:
                found[k] = known[block[k]]
            if len(self.cache) + len(short) > CACHE:
                self.cache = dict(self.mark)
            self.cache.update((c, known[c]) for c in short)
            yield from found

    def _chunks(self, text: str | None) -> list[str]:
        """The chunks of a text, in order, with an empty one for each literal mark; null and empty texts have none."""
        out: list[str] = []
        for k, part in enumerate(text.split(MARK) if text else ()):
            if k:
                out.append("")
            marked = (MARK if k == 0 else "") + part.replace(" ", MARK)
            out += _CHUNK.findall(marked) if self.cuttable else [marked] if marked else []
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        out = []
        for group in _groups(texts, TOGETHER):
            split = [self._chunks(text) for text in group]
            found = self._ids([chunk for some in split for chunk in some])
            out += [np.frombuffer(b"".join(islice(found, len(some))), "<i4") for some in split]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; null and empty texts have none."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, bytes are put together, the first space goes."""
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def load(path: str) -> Tokenizer:
    with open(path, "rb") as f:
        return Tokenizer(f.read())


def tokenize(docs: DataFrame, model_path: str) -> DataFrame:
    """Rows (doc_id, ids array<int>, n_tokens, n_bytes, round_trip) for every document's whole text.

    n_bytes counts byte-fallback ids; round_trip says that decoding gives the
    text back. Null texts count as empty. One row for each input row, repeated
    ones too; empty tables give none; other columns are not read. The driver
    reads the model file; workers get it by broadcast (half a megabyte). No
    shuffle.
    """
    model = load(model_path)
    if len(model.raw) > 64 << 20:
        raise ValueError("model file over 64 MB")
    shared = docs.sparkSession.sparkContext.broadcast({"raw": model.raw})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value  # one object for all of a worker's tasks
        t = kept.get("model") or kept.setdefault("model", Tokenizer(kept["raw"]))
        is_byte = np.array([kind == BYTE for _, _, kind in t.pieces], bool)
        for b in batches:
            # a batch's ids go out in parts, so that long texts do not add up
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = part.column(1).to_pylist()
                ids = t.encode_all(texts)
                raw = [int(is_byte[found].sum()) for found in ids]
                same = [t.decode(found.tolist()) == (text or "") for found, text in zip(ids, texts, strict=True)]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array(sizes), pa.array(raw, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "n_bytes", "round_trip"])

    return project(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_bytes long, round_trip boolean")
