"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's score is a logistic model over its different words, each counted
by itself and by its beginnings; a document's is the
noisy-or of its sentences, 1 - prod(1 - p_s). The model is trained through the
noisy-or from document labels alone, and the sentence scores then locate the
offending sentences.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, project
from .labels import allowed_labels, is_held_out, sampled, texts_of

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
#: Labelled documents of each class that fit the model, at most.
SAMPLE_PER_CLASS = 1500
#: Beginnings of words, in characters: stems that take many endings.
STEMS = range(4, 9)
REMEMBERED = 150_000
#: A word or beginning counts as a feature if this many sampled documents have it.
MIN_DOCUMENTS = 4
#: Entries of the sample that are summed at a time.
BLOCK = 1 << 18


def features(word: str) -> list[str]:
    """The word and its beginnings (which end in `*`)."""
    return [word, *(word[:k] + "*" for k in STEMS if k <= len(word))]


class Model:
    """Weights of words and beginnings, and a bias; others count nothing."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        total = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return total

    def sentences(self, text: str | None) -> Iterator[tuple[int, int, float]]:
        """(start, end, score) of every sentence, in code points."""
        known = self.known
        for m in SENTENCE.finditer(text or ""):
            words = set(WORD.findall(m[0].lower()))
            if words:
                z = self.bias + sum(known[w] if w in known else self.word(w) for w in words)
                yield m.start(), m.end(), float(1 / (1 + np.exp(-z))) if abs(z) < 500 else float(z > 0)


class _Bags:
    """Sampled documents as numbers: words by sentence, sentences by document, and each word's features.

    Texts and feature names are read one at a time and let go; only features
    with enough documents keep their names. Sums run over blocks of entries,
    so that no array of floats is as long as the sample.
    """

    def __init__(self, rows: Iterable[tuple[str | None, int]]):
        ids: dict[str, int] = {}
        word, length, doc_of, in_doc, n_in_doc, y = array("i"), array("i"), array("i"), array("i"), array("i"), array("b")
        for k, (text, label) in enumerate(rows):
            y.append(label)
            seen: set[int] = set()
            for m in SENTENCE.finditer(text or ""):
                words = {ids.setdefault(w, len(ids)) for w in set(WORD.findall(m[0].lower()))}
                if words:
                    word.extend(words)
                    length.append(len(words))
                    doc_of.append(k)
                    seen |= words
            in_doc.extend(seen)
            n_in_doc.append(len(seen))
        whole = lambda a: np.frombuffer(a, np.int32) if a else np.zeros(0, np.int32)
        self.y, self.word, self.length, self.doc_of = np.array(y, float), whole(word), whole(length), whole(doc_of)
        self.parts = _blocks(self.length)
        self.n_words, self.names, self.kinds = len(ids), [], []
        in_doc, n_in_doc = whole(in_doc), whole(n_in_doc)
        for k in (0, *STEMS):
            kind: dict[str, int] = {}
            of_word = np.fromiter((-1 if 0 < len(w) < k else kind.setdefault(w[:k] + "*" if k else w, len(kind)) for w in ids), np.int32, len(ids))
            df = np.zeros(len(kind), np.int64)
            for d, e, lo, hi in _blocks(n_in_doc):
                doc, seen = np.repeat(np.arange(e - d), n_in_doc[d:e]), of_word[in_doc[lo:hi]]
                pairs = np.unique(doc[seen >= 0] * max(len(kind), 1) + seen[seen >= 0])
                df += np.bincount(pairs % max(len(kind), 1), minlength=len(kind))[: len(kind)]
            new = np.where(df >= MIN_DOCUMENTS, np.cumsum(df >= MIN_DOCUMENTS) - 1 + len(self.names), -1)
            self.kinds.append(np.where(of_word >= 0, new[of_word] if len(new) else -1, -1).astype(np.int32))
            self.names += [name for name, i in kind.items() if df[i] >= MIN_DOCUMENTS]

    def sentence_sums(self, by_word: np.ndarray) -> np.ndarray:
        """For each sentence, the sum over its words."""
        parts = [np.bincount(np.repeat(np.arange(e - s), self.length[s:e]), by_word[self.word[lo:hi]], minlength=e - s) for s, e, lo, hi in self.parts]
        return np.concatenate([*parts, np.zeros(0)])

    def word_sums(self, by_sentence: np.ndarray) -> np.ndarray:
        """For each word, the sum over the sentences that have it."""
        out = np.zeros(self.n_words)
        for s, e, lo, hi in self.parts:
            out += np.bincount(self.word[lo:hi], np.repeat(by_sentence[s:e], self.length[s:e]), minlength=self.n_words)
        return out

    def word_scores(self, weights: np.ndarray) -> np.ndarray:
        """Each word's sum of its features' weights; feature -1 weighs 0."""
        padded = np.append(weights, 0.0)
        return sum((padded[k] for k in self.kinds), np.zeros(self.n_words))

    def feature_sums(self, by_word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.names) + 1)
        for k in self.kinds:
            out += np.bincount(np.where(k < 0, len(self.names), k), by_word, minlength=len(out))
        return out[:-1]


def _blocks(sizes: np.ndarray, most: int = BLOCK) -> list[tuple[int, int, int, int]]:
    """Runs of lists (from, to) and of their entries (from, to): about `most` entries each, whole lists."""
    ends = np.cumsum(sizes, dtype=np.int64)
    out, at, lo = [], 0, 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, lo + most, side="right")))
        out.append((at, to, lo, int(ends[to - 1])))
        at, lo = to, int(ends[to - 1])
    return out


def fit(rows: Iterable[tuple[str | None, int]], steps: int = 200, rate: float = 0.15, decay: float = 2e-4) -> Model:
    """Maximises the likelihood of document labels under the noisy-or, by Adam over all rows."""
    bags = _Bags(rows)
    y = bags.y
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y) if len(y) else y
    theta = np.zeros(len(bags.names) + 1)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1 if len(y) else 1):
        z = bags.sentence_sums(bags.word_scores(theta[:-1])) + theta[-1]
        total = np.bincount(bags.doc_of, np.logaddexp(0, z), minlength=len(y))  # -log of no toxic sentence
        none = np.exp(-total)
        by_doc = share * np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0) / len(y)
        by_sentence = by_doc[bags.doc_of] / (1 + np.exp(-z))
        grad = np.append(bags.feature_sums(bags.word_sums(by_sentence)), by_sentence.sum())
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({name: float(t) for name, t in zip(bags.names, theta[:-1].tolist(), strict=True) if abs(t) > 1e-4}, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on at most `per_class` labelled documents of each class, none of them held out."""
    known = allowed_labels(docs, labels, "toxic", folds, held_out)
    ids = sampled(known.filter("y = 1"), per_class).union(sampled(known.filter("y = 0"), per_class))
    return fit(texts_of(docs, ids))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows' (doc_id, score, offending array<struct<start,end,score>>): sentences of `threshold` or more.

    Whole texts are scored. Null, empty and wordless texts score 0. One row for
    each input row, repeated ones too; empty tables give none; other columns
    are not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # bounded by the sample's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            scores, found = [], []
            for text in b.column(1):
                clean, bad = 0.0, []
                for start, end, p in model.sentences(text.as_py()):
                    clean += np.log1p(-min(p, 1 - 1e-12))
                    if p >= threshold:
                        bad.append({"start": start, "end": end, "score": p})
                scores.append(float(-np.expm1(clean)))
                found.append(bad)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "offending"])

    return project(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>")


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, that score below `threshold`; null and empty texts stay."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def keep():
        model = Model(*shared.value)
        return lambda text: -np.expm1(sum(np.log1p(-min(p, 1 - 1e-12)) for _, _, p in model.sentences(text))) < threshold

    return filtered(docs, keep)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, offending) for every document; without a doc_id it is not held out."""
    found = score_documents(docs, train(docs, labels, folds, held_out))
    return found.select("doc_id", is_held_out(folds, held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
