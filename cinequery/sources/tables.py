"""Logical tables of the retrieval model over the driver's Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, feature_index, frame_id, pts_time, embedding)"""
    e = load(spark, sf_dir, "embeddings").withColumn("video_id", F.concat(F.lit("src"), F.col("label").cast("string")))
    index = F.row_number().over(Window.partitionBy("video_id").orderBy("vec_id")) - 1
    return e.select("video_id", index.cast("long").alias("feature_index"), F.col("vec_id").alias("frame_id"), (F.col("vec_id") / 30.0).alias("pts_time"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str, ids: list[int]) -> DataFrame:
    """(query_id, qvec): the vectors with these ids are the queries, numbered from 0."""
    place = F.array_position(F.array(*map(F.lit, ids)), F.col("vec_id").cast("int")) - 1
    return load(spark, sf_dir, "embeddings").filter(F.col("vec_id").isin(ids)).select(place.cast("int").alias("query_id"), F.col("embedding").alias("qvec"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, video_id, keyframe_number): where each text record stands."""
    d = load(spark, sf_dir, "documents")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return d.select(F.col("doc_id").alias("doc"), F.col("source").alias("video_id"), place.cast("long").alias("keyframe_number"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text, schema): text records without their places."""
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("doc"), "text", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(2).alias("schema"))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, feature_index, keyframe_number, frame_id): a frame's numbers; every fiftieth vector has none."""
    f = frames(spark, sf_dir).filter(F.col("frame_id") % 50 != 49)
    return f.select("video_id", "feature_index", (F.col("feature_index") + 1).alias("keyframe_number"), "frame_id")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, title, description, keywords): the first parts describe the videos."""
    p = load(spark, sf_dir, "part").filter("p_partkey < 20")
    video = F.concat(F.lit("src"), F.col("p_partkey").cast("string"))
    return p.select(video.alias("video_id"), F.col("p_name").alias("title"), F.lit("").alias("description"), F.array("p_brand", "p_type").alias("keywords"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, keyframe_number, labels): a part's name and size on each mapped frame; every seventh frame has none."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.array("p_name", F.lower("p_type")).alias("labels"))
    n = p.select(F.count("*").alias("n"))
    m = mapping(spark, sf_dir).filter(F.col("frame_id") % 7 != 0).join(F.broadcast(n))
    return m.join(p, (F.col("frame_id") * 3) % F.col("n") == F.col("p_partkey")).select("video_id", "keyframe_number", "labels")


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): a passage as visible text, and parts as objects and titles, for every benchmark item."""
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    p = load(spark, sf_dir, "part")
    o = p.select(F.col("p_partkey").alias("_o"), F.col("p_name").alias("_object"))
    m = p.select(F.col("p_partkey").alias("_m"), F.concat_ws(" ", "p_name", "p_brand").alias("_title"))
    b = b.join(F.broadcast(p.select(F.count("*").alias("n"))))
    b = b.join(o, (F.col("query_id") * 3 + 1) % F.col("n") == F.col("_o")).join(m, F.col("query_id") % 10 == F.col("_m"))
    return b.select("query_id", F.concat(F.lit("walking scene says "), "text", F.lit(". what color object "), "_object", F.lit(". video title "), "_title").alias("query"))


def stub_vectors(spark: SparkSession, sf_dir: str, searches: DataFrame) -> DataFrame:
    """`searches` (query_id, place, ..) with qvec, a stored vector that their numbers choose; no encoder is shipped."""
    e = load(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("_v"), F.col("embedding").alias("qvec"))
    s = searches.join(F.broadcast(e.select(F.count("*").alias("n"))))
    return s.join(v, (F.col("query_id") * 7 + F.col("place") * 101) % F.col("n") == F.col("_v")).drop("n", "_v")
