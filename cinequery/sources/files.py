"""Readers and writers of the model's own file formats."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OCR_SCHEMA = "video_id string, keyframe_number int, text string, ocr_schema int, text_quality double"


#: Fixed keys whose strings are labels.
LABEL_KEYS = ("label", "labels", "name", "class", "class_name", "display_name", "category", "category_name")
#: Fixed: the newest schema of text records.
NEWEST_OCR = 2


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def first_existing(spark: SparkSession, paths: list[str], required: bool = True) -> str | None:
    """The first of several places that is there; none is an error where one is required."""
    found = next((p for p in paths if exists(spark, p)), None)
    if found is None and required:
        raise FileNotFoundError(f"none of {paths} exists")
    return found


def dataset_paths(spark: SparkSession, root: str, layouts: dict[str, list[str]], required: tuple[str, ...], overrides: dict[str, str] | None = None) -> dict[str, str | None]:
    """Each component's folder: its override, else the first of its layouts below `root` that is there."""
    own = overrides or {}
    return {name: own.get(name) or first_existing(spark, [f"{root}/{p}" for p in places], name in required) for name, places in layouts.items()}


def paired(features: DataFrame, mapping: DataFrame) -> DataFrame:
    """Features (video_id, ..) of videos that have a mapping; none at all is an error."""
    found = features.join(mapping.select("video_id"), "video_id", "left_semi")
    if found.limit(1).count() == 0:
        raise ValueError("no video has both features and a mapping")
    return found


def count_vectors(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table, from its footers."""
    return spark.read.parquet(path).count()


def labels_in(text: str | None) -> list[str]:
    """Different labels of a JSON text, in order: strings below a label key, at any depth; a list's items stand below its key."""

    def walk(value: object, below: bool) -> Iterator[str]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, k.lower() in LABEL_KEYS)
        elif isinstance(value, list):
            for v in value:
                yield from walk(v, below)
        elif isinstance(value, str) and below and value.strip():
            yield value.strip()

    try:
        return list(dict.fromkeys(walk(json.loads(text or ""), False)))
    except ValueError:
        return []


def object_labels(text: Column | str) -> Column:
    """`labels_in` for each JSON text; malformed and null ones have none."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(labels_in)

    return F.pandas_udf(run, "array<string>")(text)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Object JSON files, <video>/<keyframe>.json each: (video_id, keyframe_number, labels)."""
    raw = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path)
    name = F.input_file_name()
    return raw.select(F.regexp_extract(name, r"([^/]+)/[^/]+\.json$", 1).alias("video_id"), F.regexp_extract(name, r"(\d+)\.json$", 1).cast("int").alias("keyframe_number"), object_labels("value").alias("labels"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzip; what is no object of the schema is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).na.drop("all")


def import_ocr(spark: SparkSession, source: str, destination: str) -> int:
    """Installs a text index after a strict look: every line must be a record with video_id and keyframe_number. Returns its records.

    Records go to `destination` as gzipped JSON lines, schema and count to `destination`.complete.
    """
    raw = spark.read.text(source)
    parsed = raw.select(F.from_json("value", OCR_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("_v"), "value")
    key = F.expr("try_variant_get(_v, '$.video_id', 'string')")
    bad = F.col("_v").isNull() | F.coalesce(key, F.lit("")).eqNullSafe("") | F.expr("variant_get(_v, '$.keyframe_number') IS NULL")
    schema = F.when(F.coalesce("r.ocr_schema", F.lit(0)) == 0, 1).otherwise(F.col("r.ocr_schema"))
    row = parsed.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.least(F.min(schema), F.lit(NEWEST_OCR)).alias("schema")).first()
    if row.bad or not row.n:
        raise ValueError(f"no sound text index: {source} ({row.n} lines, {row.bad} of them bad)")
    raw.write.mode("overwrite").option("compression", "gzip").text(destination)
    marker = spark.createDataFrame([(row.schema, row.n, source)], "ocr_schema int, records long, imported_from string")
    marker.coalesce(1).write.mode("overwrite").json(f"{destination}.complete")
    return row.n


def ocr_schema(spark: SparkSession, index: str, marker: str) -> int:
    """The schema in the marker, else in the first record, else 0."""
    if exists(spark, marker) and (rows := spark.read.schema("ocr_schema int").json(marker).filter("ocr_schema > 0").limit(1).collect()):
        return rows[0].ocr_schema
    if not exists(spark, index):
        return 0
    first = spark.read.schema("ocr_schema int, video_id string").json(index).limit(1).collect()
    return (first[0].ocr_schema or 1) if first and first[0].video_id is not None else 0


def cached(spark: SparkSession, path: str, fingerprint: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table kept at `path` if it was built for this fingerprint, else built and kept."""
    at = f"{path}/{fingerprint}"
    if not exists(spark, f"{at}/_SUCCESS"):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def fingerprint(root: str, model: str, config: str, files: DataFrame) -> Column:
    """The first 20 digits of a SHA-256 over root, model, settings and the files (path, length, modified) in order; for an aggregate over `files`."""
    rows = F.array_sort(F.collect_list(F.struct("path", "length", "modified")))  # a row a video
    text = F.concat_ws("\n", F.lit(root), F.lit(model), F.lit(config), F.array_join(F.transform(rows, lambda r: F.concat_ws("|", r.path, r.length, r.modified)), "\n"))
    return F.substring(F.sha2(text, 256), 1, 20)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth files, a JSON object each: (query, task, video_id, start, end, answers, intervals). An unknown task fails the read.

    A single answer stands for a list of one; intervals are pairs (start, end).
    """
    schema = "task string, video_id string, start long, end long, answer string, answers array<string>, intervals array<array<long>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    task = F.lower("task")
    known = F.when(task.isin("kis", "qa", "trake"), task).otherwise(F.raise_error(F.concat(F.lit("unknown task "), F.coalesce("task", F.lit("null")))))
    answers = F.when(F.size(F.coalesce("answers", F.array().cast("array<string>"))) > 0, F.col("answers")).otherwise(F.array(F.coalesce("answer", F.lit(""))))
    intervals = F.transform("intervals", lambda p: F.struct(F.get(p, F.lit(0)).alias("start"), F.get(p, F.lit(1)).alias("end")))
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return raw.select(name.alias("query"), known.alias("task"), "video_id", "start", "end", answers.alias("answers"), intervals.alias("intervals"))


def exported(results: DataFrame, selected: DataFrame, frames: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """The selected results (id, rank, video_id, frame_id, ..), by rank, with frames and answers put right.

    `frames` (id, frame_id) and `answers` (id, answer) override; a frame below 0
    counts as 0; answers must have 1 to 200 characters.
    """
    out = results.join(selected.select("id"), "id", "left_semi").join(frames.select("id", F.greatest(F.col("frame_id"), F.lit(0)).alias("_f")), "id", "left")
    out = out.withColumn("frame_id", F.coalesce("_f", "frame_id")).drop("_f")
    if answers is not None:
        said = F.trim("answer")
        sound = F.when(F.length(said).between(1, 200), said).otherwise(F.raise_error(F.lit("an answer must have 1 to 200 characters")))
        out = out.join(answers.select("id", sound.alias("_a")), "id", "left").withColumn("answer", F.coalesce("_a", "answer")).drop("_a")
    return out


def write_index(records: DataFrame, path: str) -> None:
    """Records as gzipped JSON lines."""
    records.write.mode("overwrite").option("compression", "gzip").json(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Mapping CSV files (n, frame_idx, pts_time, fps), a file a video; a bad row fails the read."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    video = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    whole = lambda c: F.col(c).cast("double").cast("bigint")
    return raw.select(video.alias("video_id"), whole("n").cast("int").alias("keyframe_number"), whole("frame_idx").alias("frame_id"), F.col("pts_time").cast("double"), F.col("fps").cast("double"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata JSON files, a file a video; what is missing or malformed is empty."""
    raw = spark.read.schema("title string, description string, keywords array<string>").option("multiLine", True).json(path)
    video = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return raw.select(video.alias("video_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """Text records in JSON lines, plain or gzip; malformed and blank ones are dropped, a missing schema is 1."""
    raw = spark.read.schema(OCR_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    raw = raw.filter(F.col("video_id").isNotNull() & (F.trim("text") != ""))
    return raw.select("video_id", "keyframe_number", "text", F.when(F.coalesce("ocr_schema", F.lit(0)) == 0, 1).otherwise(F.col("ocr_schema")).alias("ocr_schema"), F.coalesce("text_quality", F.lit(1.0)).alias("text_quality"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions as text columns; a mark of UTF-8 in front is no part of the first name."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return raw.toDF(*[c.removeprefix("\ufeff") for c in raw.columns])


def discover_videos(spark: SparkSession, path: str) -> DataFrame:
    """Video files below a folder: (path, length), sorted; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return found.filter(F.lower("path").rlike(r"\.(mp4|mkv|avi|mov|webm)$")).orderBy("path")


def write_ranked(df: DataFrame, path: str, columns: list[str], limit: int = 100) -> None:
    """The first `limit` rows by rank as one CSV file with a header, which spreadsheets know as UTF-8 by its mark."""
    first, *rest = columns
    top = df.orderBy("rank").limit(limit).select(F.col(first).alias(f"\ufeff{first}"), *rest)
    top.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def wide_sequences(paths: DataFrame, events: int) -> DataFrame:
    """Sequences (rank, video_id, path) as columns frame_id_1 .. frame_id_N; short ones end in nulls."""
    return paths.select("rank", "video_id", *[F.get("path", F.lit(i)).alias(f"frame_id_{i + 1}") for i in range(events)])
