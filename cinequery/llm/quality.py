"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled good documents; the rest of the corpus is
unlabelled. The class prior pi is estimated from the two. With it, the risk of a scorer is
pi R_p(+) + max(0, R_u(-) - pi R_p(-)), the second term being an unbiased
estimate of the negatives' risk that is kept from falling below zero. The
scorer is a logistic model over binned measures of a text's shape, so its
output estimates the probability of good quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import project
from .labels import allowed_labels, is_held_out, one_text_each, sampled

#: Trusted positives and unlabelled documents that fit the model, at most.
POSITIVES, UNLABELLED = 3000, 6000
BINS = 16
_SYMBOLS = b"!|#$%&*.,:;/<>=@_\"'-+?()[]{}\\~^`"
_GROUPS = (range(97, 123), range(65, 91), range(48, 58), (32,), (10,), range(128, 256), range(0, 9), *((c,) for c in _SYMBOLS))
_TABLE = np.zeros((256, len(_GROUPS)))
for _k, _g in enumerate(_GROUPS):
    _TABLE[list(_g), _k] = 1.0


def measures(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes, and lengths and repetition of words and lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    nw, nl = max(len(words), 1), max(len(lines), 1)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    more = [np.log1p(len(words)), np.log1p(len(lines)), sizes.mean(), sizes.std(), sizes.max(), len(set(words)) / nw, len(set(lines)) / nl, np.log1p(len(raw) / nl)]
    return np.append(shares, more)


N_MEASURES = len(_GROUPS) + 8


class Model:
    """A weight for each measure's bin, and a bias."""

    def __init__(self, edges: list[np.ndarray], weights: list[np.ndarray], bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for k, (edge, w) in enumerate(zip(self.edges, self.weights, strict=True)):
            z += w[np.searchsorted(edge, x[:, k], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1000, rate: float = 0.03, decay: float = 3e-3, slack: float = 0.0) -> Model:
    """Minimises the non-negative risk by Adam; a step that would drive the negatives' risk below -`slack` goes back up it instead."""
    both = np.vstack([positive, unlabelled])
    edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(both) else np.zeros(0) for k in range(both.shape[1])]
    starts = np.cumsum([0, *(len(e) + 1 for e in edges)])
    place = lambda x: np.stack([np.searchsorted(e, x[:, k], side="right") + starts[k] for k, e in enumerate(edges)], 1)
    p, u = place(positive), place(unlabelled)
    theta = np.zeros(starts[-1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v, mean = np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def gradient(at: np.ndarray, by_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(at.ravel(), np.repeat(by_row, at.shape[1]), minlength=starts[-1]), by_row.sum())

    for step in range(1, steps + 1 if len(p) and len(u) else 1):
        zp, zu = theta[p].sum(1) + theta[-1], theta[u].sum(1) + theta[-1]
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = gradient(u, sig(zu) / len(u)) - prior * gradient(p, sig(zp) / len(p))
        if negative_risk >= -slack:
            grad = negative + prior * gradient(p, -sig(-zp) / len(p))
        else:
            grad = -negative
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        mean += theta * (step > steps // 2) / (steps - steps // 2)  # steps near zero risk swing; their mean does not
    theta = mean if len(p) and len(u) else theta
    return Model(edges, [theta[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)], float(theta[-1]))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 4, confidence: float = 0.05) -> float:
    """The share of positives among unlabelled rows, by the best bin: the least ratio of the shares of unlabelled and positive rows above a score.

    Scores tell positives from unlabelled rows and come from models that have
    not seen them, fold by fold. No score's ratio can lie below the share, and
    where only positives reach a score it meets it; each ratio is taken with the
    slack that so few rows leave, so that chance does not choose it. Without rows
    on both sides it is 0.5.
    """
    if len(positive) < folds or len(unlabelled) < folds:
        return 0.5
    sp, su = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for k in range(folds):
        outp, outu = np.arange(len(positive)) % folds == k, np.arange(len(unlabelled)) % folds == k
        model = fit(positive[~outp], unlabelled[~outu], 0.5, steps=300)
        sp[outp], su[outu] = model.scores(positive[outp]), model.scores(unlabelled[outu])
    cuts = np.quantile(sp, np.linspace(0.05, 0.99, 95))
    above_p = np.array([(sp >= c).mean() for c in cuts])
    above_u = np.array([(su >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / confidence) / (2 * len(su))) + np.sqrt(np.log(4 / confidence) / (2 * len(sp)))
    keep = above_p > slack
    ratio = above_u[keep] / above_p[keep]
    if not len(ratio):
        return 0.5
    best = np.argmin(ratio + slack * (1 + ratio) / above_p[keep])
    return float(np.clip(ratio[best], 0.01, 0.99))


def measured(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """The measures of the documents in `ids`, whose row count the caller has bounded, in an order by hash; texts stay on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measures(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    found = one_text_each(docs, ids).select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id").select("x").toArrow().column(0).to_pylist()
    return np.array(rows, float).reshape(-1, N_MEASURES)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fits on bounded samples of trusted positives and of the unlabelled corpus, neither from the held-out fold; the prior is estimated from both.

    Labels of bad quality are not read. Without positives or documents the
    model gives 0.5.
    """
    known = allowed_labels(docs, labels, "quality", folds, held_out)
    p = measured(docs, sampled(known.filter("y = 1").select("doc_id"), positives))
    u = measured(docs, sampled(project(docs, doc_id="long").filter("doc_id IS NOT NULL").filter(~is_held_out(folds, held_out)).distinct(), unlabelled))
    return fit(p, u, estimated_prior(p, u))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score): the probability of good quality of each whole text.

    Null texts count as empty and get a score like any other. One row for each
    input row, repeated ones too; empty tables give none; other columns are
    not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.edges, model.weights, model.bias))  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            x = np.array([measures(t.as_py()) for t in b.column(1)]).reshape(-1, N_MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])

    return project(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every document; without a doc_id it is not held out."""
    found = score_documents(docs, train(docs, labels, folds, held_out))
    return found.select("doc_id", is_held_out(folds, held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
