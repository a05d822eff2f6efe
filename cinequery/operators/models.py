"""Where models plug in: each distinct input is scored once, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class PairScorer(Protocol):
    def score(self, queries: list[str], texts: list[str]) -> list[float]: ...


class VectorEncoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class VisualAnswerer(Protocol):
    def answer(self, questions: list[str], evidence: list[str]) -> list[tuple[str, float]]: ...


class TokenOverlap:
    """A pair scorer without a model: shared words over the query's words."""

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        def one(q: str, t: str) -> float:
            words = set(q.lower().split())
            return len(words & set(t.lower().split())) / len(words) if words else 0.0

        return [one(q, t) for q, t in zip(queries, texts, strict=True)]


def score_pairs(pairs: DataFrame, scorer: Callable[[], PairScorer], query: str = "query", text: str = "text") -> DataFrame:
    """`pairs` with a column score. `scorer` makes the model once a task; nulls count as empty text."""
    filled = pairs.fillna("", [query, text])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for b in batches:
            yield b.assign(score=[float(s) for s in model.score(b[query].tolist(), b[text].tolist())])

    scored = filled.select(query, text).distinct().mapInPandas(run, f"`{query}` string, `{text}` string, score double")
    return filled.join(scored, [query, text], "left")


def encode_texts(texts: DataFrame, encoder: Callable[[], VectorEncoder], text: str = "text") -> DataFrame:
    """(text, embedding) for each distinct text that is not null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for b in batches:
            yield b.assign(embedding=model.encode(b[text].tolist()))

    return texts.select(text).na.drop().distinct().mapInPandas(run, f"`{text}` string, embedding array<double>")


def answer_questions(rows: DataFrame, answerer: Callable[[], VisualAnswerer], question: str = "question", evidence: str = "evidence") -> DataFrame:
    """`rows` with (answer, confidence) for each distinct question and evidence."""
    filled = rows.fillna("", [question, evidence])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = answerer()
        for b in batches:
            found = model.answer(b[question].tolist(), b[evidence].tolist())
            yield b.assign(answer=[a for a, _ in found], confidence=[float(c) for _, c in found])

    answered = filled.select(question, evidence).distinct().mapInPandas(run, f"`{question}` string, `{evidence}` string, answer string, confidence double")
    return filled.join(answered, [question, evidence], "left")
