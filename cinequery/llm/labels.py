"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import project


def bucket(folds: int) -> Column:
    """crc32 of doc_id as text, modulo `folds`."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def is_held_out(folds: int, held_out: int) -> Column:
    """Whether a document is in the held-out fold; one without a doc_id is not."""
    return F.coalesce(bucket(folds) == held_out, F.lit(False))


def allowed_labels(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """Rows (doc_id, y) of labelled documents outside the held-out fold; a doc_id with several labels takes the largest."""
    y = project(labels, doc_id="long", **{label: "int"}).filter(f"doc_id IS NOT NULL AND {label} IN (0, 1)")
    y = y.filter(bucket(folds) != held_out).groupBy("doc_id").agg(F.max(label).alias("y"))
    return y.join(project(docs, doc_id="long").distinct(), "doc_id", "left_semi")


#: Bytes of text that a sample holds, at most.
SAMPLE_BYTES = 256 << 20


def one_text_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents in `ids` (doc_id, ..), one row each: of several texts under one doc_id the smallest; null counts as smallest."""
    d = project(docs, doc_id="long", text="string")
    texts = d.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNotNull(), "text")).alias("t"))
    return texts.select("doc_id", F.col("t.text").alias("text")).join(ids, "doc_id")


def texts_of(docs: DataFrame, ids: DataFrame, most_bytes: int = SAMPLE_BYTES) -> Iterator[tuple]:
    """(text, *other columns of ids) for the documents in `ids`, whose row count the caller has bounded, in an order by hash, up to `most_bytes` of text; one at a time."""
    rows = one_text_each(docs, ids).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", *[c for c in ids.columns if c != "doc_id"])
    size = 0
    for k, r in enumerate(rows.toLocalIterator()):
        size += len((r.text or "").encode("utf-8", "surrogatepass"))
        if k and size > most_bytes:
            return
        yield tuple(r)


def sampled(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, by a hash of doc_id."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
