"""The operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, quality, secrets, sentencepiece, shuffle, simhash, substring, topk, toxicity
from .common import project, table

#: Where the public vocabulary lies; a parameter of the tokeniser.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector. Vectors that are null or not whole, and null ids, take no part; rows equal in id and values count once."""
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, with linked weak parts; null texts are empty, repeated rows stay."""
    return secrets.counted(secrets.scan(table(spark, sf_dir, "documents")))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and the planted one, read back from their formatted text. Turns come as records of three layouts; null texts and roles are empty, a null conv_id is one conversation."""
    return chat.conversation_digests(chat.format_turns(chat.canonical_rows(chat.as_records(chat.with_planted(table(spark, sf_dir, "conversations"))))))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot by the law `rows`; null texts have size 1, repeated rows get slots of their own."""
    d = project(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    d = d.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"))
    out = shuffle.shuffled_shards(d, "size", ["doc_id", "text"], shards=8)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of every document when windows of 20 that start earlier elsewhere are cut; null texts have no words."""
    return substring.kept_digest(substring.substring_dedup(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of toxicity for every document, with its offending sentences; empty texts score 0."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, copied or edited, and where; empty texts and items are in no row."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and whether they decode to its text; null and empty texts have none."""
    return sentencepiece.tokenize(table(spark, sf_dir, "documents"), MODEL_PATH)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; texts without words have fingerprint zero."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of quality for every document, empty ones too."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_topk, op2_secret_scans, op3_chat_formatting, op4_sharding, op5_substring_dedup, op6_toxicity, op7_benchmark_decontamination, op8_sentencepiece, op9_simhash_near_dedup, op10_quality_classifier)
}

TOPK_SQL = """
WITH v AS (SELECT DISTINCT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.e AS qe, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND (q.vec_id <> c.vec_id OR q.e <> c.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id, qe ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM r, range(20) t(k)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, count(*) AS n, string_agg(w[p.p], ' ' ORDER BY p.p) AS kept FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

ORACLES: dict[str, str] = {"op1_exact_topk": TOPK_SQL, "op2_secret_scans": secrets.oracle(), "op3_chat_formatting": chat.oracle(), "op5_substring_dedup": SUBSTRING_SQL}
