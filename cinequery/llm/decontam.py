"""Benchmark decontamination: bounds on the alignment score choose passages, Smith-Waterman decides.

An alignment that reaches the threshold has a least number of the item's words
and a greatest length. So a document must hold one of the item's rarer words,
enough of its words in all, and a stretch where these lie close; where all that
holds, the passage is aligned with the item. These are bounds, not guesses: no
passage that reaches the threshold is left out. Texts are read once, where they
are. Items are taken in blocks of bounded size, one broadcast a block.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import filtered, project

LEAST_WORDS = 3  # in an item
BLOCK_WORDS = 500_000  # words of items in one block (at most some 100 MB in a worker)
MATCH, MISMATCH, GAP = 2, -1, -1
_PUNCTUATION = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


#: Scripts written without spaces (Thai to Khmer, kana, ideographs): each character is a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation, as UTF-8; in scripts without spaces each character is one."""
    text = text or ""
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()


class Items:
    """A block of test items with their words numbered, and what an alignment of each must hold."""

    def __init__(self, rows: list[tuple[int, str | None]], threshold: float):
        self.vocabulary: dict[bytes, int] = {}
        self.ids = [i for i, _ in rows]
        self.codes = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)], np.int64) for _, t in rows]
        self.distinct = [np.unique(c, return_counts=True) for c in self.codes]
        self.need = [max(1.0, threshold * MATCH * len(c)) for c in self.codes]
        self.least = [math.ceil(n / MATCH) for n in self.need]  # words of the item in an alignment that reaches `need`
        # with m words in it, it stands at most MATCH * m - need words that do not match
        self.span = [int((1 + MATCH) * len(c) - n) for c, n in zip(self.codes, self.need, strict=True)]
        self._flags = np.zeros(len(self.vocabulary) + 1, bool)
        commonness = np.bincount(np.concatenate([*(d for d, _ in self.distinct), np.zeros(0, np.int64)]), minlength=len(self._flags))
        # words of which an alignment cannot do without all: the rarest, by items, that leave fewer than `least` places
        rare: dict[int, list[int]] = defaultdict(list)
        for k, (codes, times) in enumerate(self.distinct):
            if LEAST_WORDS <= len(self.codes[k]) and self.least[k] <= len(self.codes[k]):
                order = np.argsort(commonness[codes], kind="stable")
                upto = int(np.searchsorted(np.cumsum(times[order]), len(self.codes[k]) - self.least[k], side="right"))
                for code in codes[order[: upto + 1]].tolist():
                    rare[code].append(k)
        self.rare = {code: np.array(at) for code, at in rare.items()}

    @classmethod
    def of(cls, kept: dict, threshold: float) -> Items:
        """The block's items, made once in a worker."""
        return kept.get("items") or kept.setdefault("items", cls(kept["rows"], threshold))

    def encode(self, found: list[bytes]) -> np.ndarray:
        """Words by number, 0 if no item has them."""
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in found], np.int64)

    def candidates(self, codes: np.ndarray) -> list[int]:
        """Items with enough of their words anywhere in the text."""
        present = np.unique(codes)
        lists = [self.rare[c] for c in present.tolist() if c in self.rare]
        if not lists:
            return []
        self._flags[present] = True
        out = [k for k in np.unique(np.concatenate(lists)).tolist() if self.distinct[k][1][self._flags[self.distinct[k][0]]].sum() >= self.least[k]]
        self._flags[present] = False
        return out

    def stretches(self, k: int, codes: np.ndarray) -> list[tuple[int, int]]:
        """Places (from, to) that hold every alignment of item k that reaches `need`.

        Each word of the item counts as a match and each other one as a mismatch,
        which no alignment exceeds; sums run over `span` words at most.
        """
        self._flags[self.distinct[k][0]] = True
        total = np.concatenate([[0], np.cumsum(np.where(self._flags[codes], MATCH, MISMATCH))])
        self._flags[self.distinct[k][0]] = False
        if (total - np.minimum.accumulate(total)).max() < self.need[k]:
            return []
        span, least, width = self.span[k], total.copy(), 1  # least: over the last `width` sums
        while width < span + 1:
            step = min(width, span + 1 - width)
            least[step:] = np.minimum(least[step:], least[:-step].copy())
            width += step
        out: list[tuple[int, int]] = []
        for end in np.flatnonzero(total - least >= self.need[k]).tolist():
            lo = max(0, end - span)
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((lo, end))
        return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: (score, start, end) of the best local alignment in `passage`."""
    n, steps = len(passage), np.arange(len(passage) + 1) * -GAP
    h = np.zeros((len(item) + 1, n + 1), np.int64)
    for i, w in enumerate(item.tolist(), 1):
        row = np.zeros(n + 1, np.int64)
        row[1:] = np.maximum(0, np.maximum(h[i - 1, :-1] + np.where(passage == w, MATCH, MISMATCH), h[i - 1, 1:] + GAP))
        h[i] = np.maximum.accumulate(row + steps) - steps  # gaps along the passage
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    best, end = int(h[i, j]), int(j)
    while i and j and h[i, j]:
        if h[i, j] == h[i - 1, j - 1] + (MATCH if item[i - 1] == passage[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, int(j), end


def passages(items: Items, codes: np.ndarray, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item, score, start word, end word) of aligned passages that reach the threshold, the best for each item."""
    out = []
    for item in items.candidates(codes):
        length, span, best = len(items.codes[item]), items.span[item], None
        for lo, hi in items.stretches(item, codes):
            # long stretches are cut, with the overlap of a whole alignment
            for a in range(lo, max(lo + 1, hi - span), 4 * length + 1):
                score, start, end = align(items.codes[item], codes[a : min(hi, a + 4 * length + 1 + span)])
                now = (score / (MATCH * length), a + start, a + end)
                if now[0] >= threshold and (best is None or now[0] > best[0]):
                    best = now
        if best:
            out.append((item, *best))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, item_id, score, start_word, end_word): documents that hold an item, copied or edited.

    score is the alignment's share of a verbatim copy's; `threshold` or more
    counts, the best passage a pair. Items of fewer than three words are
    never reported; null items and texts are empty. Rows of
    documents that repeat give rows that repeat. Empty tables give no rows;
    other columns are not read.
    """
    d = project(docs, doc_id="long", text="string")
    schema = "doc_id long, item_id long, score double, start_word int, end_word int"
    out = None
    for items in item_blocks(benchmark, block_words):

        def find(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            it = Items.of(items.value, threshold)
            for b in batches:
                rows = [(doc, it.ids[k], s, a, e) for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for k, s, a, e in passages(it, it.encode(words(text.as_py())), threshold)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "score", "start_word", "end_word"])

        found = d.mapInArrow(find, schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns as they are, that hold no item (see `contaminated`)."""
    out = docs
    for items in item_blocks(benchmark, block_words):

        def keep(items=items):
            it = Items.of(items.value, threshold)
            return lambda text: not passages(it, it.encode(words(text)), threshold)

        out = filtered(out, keep)
    return out


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[Broadcast]:
    """The rows of each block of items, for `Items.of`."""
    for block in _blocks(project(benchmark, item_id="long", text="string"), block_words):
        yield benchmark.sparkSession.sparkContext.broadcast({"rows": block})


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str | None]]]:
    """Items, streamed into blocks of at most `most` words (a longer item stands alone)."""
    block, size = [], 0
    for r in benchmark.orderBy("item_id", "text").toLocalIterator():
        n = len((r.text or "").split())
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    if block:
        yield block
