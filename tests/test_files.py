"""Readers, writers and checks of files, over files written here."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from cinequery.operators import preprocess
from cinequery.sources import files


def write(path, text, mode="wt"):
    path.parent.mkdir(parents=True, exist_ok=True)
    opened = gzip.open(path, mode, encoding="utf-8") if path.suffix == ".gz" else path.open(mode, encoding="utf-8")
    with opened as f:
        f.write(text)
    return str(path)


def test_mapping_and_metadata(spark, tmp_path):
    write(tmp_path / "m/L01.csv", "n,frame_idx,pts_time,fps\n1,0.0,0.0,30.0\n2,45,1.5,30.0\n")
    assert [tuple(r) for r in files.read_mapping(spark, f"{tmp_path}/m").orderBy("keyframe_number").collect()] == [("L01", 1, 0, 0.0, 30.0), ("L01", 2, 45, 1.5, 30.0)]
    write(tmp_path / "meta/L01.json", json.dumps({"title": "Aurora", "keywords": ["a", "b"]}))
    write(tmp_path / "meta/L02.json", "{broken")
    got = {r.video_id: (r.title, r.description, r.keywords) for r in files.read_metadata(spark, f"{tmp_path}/meta").collect()}
    assert got == {"L01": ("Aurora", "", ["a", "b"]), "L02": ("", "", [])}


def test_text_records_drop_what_is_malformed_or_blank(spark, tmp_path):
    lines = [{"video_id": "a", "keyframe_number": 1, "text": "x"}, {"video_id": "a", "keyframe_number": 2, "text": "  "}, {"video_id": "b", "keyframe_number": 3, "text": "y", "ocr_schema": 2, "text_quality": 0.5}]
    path = write(tmp_path / "o.jsonl.gz", "\n".join([*map(json.dumps, lines), "{bad"]) + "\n")
    got = [tuple(r) for r in files.read_ocr(spark, path).orderBy("video_id").collect()]
    assert got == [("a", 1, "x", 1, 1.0), ("b", 3, "y", 2, 0.5)]


def test_import_is_strict_and_leaves_a_marker(spark, tmp_path):
    good = write(tmp_path / "good.jsonl", '{"video_id":"a","keyframe_number":1,"text":"x"}\n{"video_id":"b","keyframe_number":2,"text":"","ocr_schema":2}\n')
    out = f"{tmp_path}/out"
    assert files.import_ocr(spark, good, out) == 2
    assert files.read_ocr(spark, out).count() == 1
    assert files.ocr_schema(spark, out, f"{out}.complete") == 1
    for k, bad in enumerate(('{"video_id":"a"}\n', '{"keyframe_number":1}\n', '{"video_id":"","keyframe_number":1}\n', "{nope\n", "")):
        with pytest.raises(ValueError):
            files.import_ocr(spark, write(tmp_path / f"bad{k}.jsonl", bad), f"{tmp_path}/no{k}")


def test_schema_of_an_index_without_a_marker(spark, tmp_path):
    two = write(tmp_path / "two.jsonl", '{"video_id":"a","keyframe_number":1,"ocr_schema":2}\n')
    old = write(tmp_path / "old.jsonl", '{"video_id":"a","keyframe_number":1}\n')
    none = f"{tmp_path}/none"
    assert [files.ocr_schema(spark, p, none) for p in (two, old, none)] == [2, 1, 0]


def test_object_labels_of_nested_json(spark, tmp_path):
    text = json.dumps({"Label": " car ", "items": [{"class_name": ["dog", " ", {"name": "tail"}]}, {"x": "no"}], "labels": ["car", "tree"], "category": {"deep": "no"}})
    write(tmp_path / "obj/L01/0012.json", text)
    write(tmp_path / "obj/L01/0013.json", "{broken")
    got = {(r.video_id, r.keyframe_number): r.labels for r in files.read_objects(spark, f"{tmp_path}/obj").collect()}
    assert got == {("L01", 12): ["car", "dog", "tail", "tree"], ("L01", 13): []}


def test_places_pairs_and_counts(spark, tmp_path):
    write(tmp_path / "b/x.txt", "")
    assert files.first_existing(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]) == f"{tmp_path}/b"
    assert files.first_existing(spark, [f"{tmp_path}/a"], required=False) is None
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [f"{tmp_path}/a"])
    layouts = {"maps": ["a", "b"], "objects": ["c"]}
    assert files.dataset_paths(spark, str(tmp_path), layouts, ("maps",), {"objects": "/else"}) == {"maps": f"{tmp_path}/b", "objects": "/else"}
    f = spark.createDataFrame([("a", 0), ("b", 0)], "video_id string, feature_index int")
    m = spark.createDataFrame([("a", 1)], "video_id string, n int")
    assert [r.video_id for r in files.paired(f, m).collect()] == ["a"]
    with pytest.raises(ValueError):
        files.paired(f, m.limit(0))
    f.write.parquet(f"{tmp_path}/v")
    assert files.count_vectors(spark, f"{tmp_path}/v") == 2


def test_videos_are_found_below_folders(spark, tmp_path):
    for name in ("b/two.MP4", "one.mkv", "notes.txt"):
        write(tmp_path / name, "x")
    assert [r.path.rsplit("/", 1)[1] for r in files.discover_videos(spark, str(tmp_path)).collect()] == ["two.MP4", "one.mkv"]


def test_truth_and_predictions(spark, tmp_path):
    write(tmp_path / "t/q1.json", json.dumps({"task": "QA", "video_id": "a", "start": 1, "end": 9, "answer": "five"}))
    write(tmp_path / "t/q2.json", json.dumps({"task": "trake", "video_id": "b", "intervals": [[1, 2], [3, 4]]}))
    got = {r["query"]: r for r in files.read_truth(spark, f"{tmp_path}/t").collect()}
    assert (got["q1"].task, got["q1"].answers, got["q1"].start) == ("qa", ["five"], 1)
    assert [tuple(i) for i in got["q2"].intervals] == [(1, 2), (3, 4)]
    write(tmp_path / "u/q.json", json.dumps({"task": "other"}))
    with pytest.raises(Exception, match="unknown task"):
        files.read_truth(spark, f"{tmp_path}/u").collect()
    rows = spark.createDataFrame([(2, "v2", 7), (1, "v1", 5), (3, "v3", 9)], "rank int, video_id string, frame_id long")
    files.write_ranked(rows, f"{tmp_path}/csv", ["video_id", "frame_id"], limit=2)
    part = next((tmp_path / "csv").glob("part-*.csv")).read_bytes()
    assert part == "﻿video_id,frame_id\nv1,5\nv2,7\n".encode()
    assert [tuple(r) for r in files.read_predictions(spark, f"{tmp_path}/csv").collect()] == [("v1", "5"), ("v2", "7")]


def test_export_puts_right_frames_and_answers(spark):
    r = spark.createDataFrame([("a", 1, "L01", 100, "two"), ("b", 2, "L02", 150, ""), ("c", 3, "L03", 9, "")], "id string, rank int, video_id string, frame_id long, answer string")
    chosen = r.filter("id <> 'c'").select("id")
    frames = spark.createDataFrame([("a", 123), ("c", 1)], "id string, frame_id long")
    answers = spark.createDataFrame([("b", " five ")], "id string, answer string")
    got = [tuple(x) for x in files.exported(r, chosen, frames, answers).orderBy("rank").collect()]
    assert got == [("a", 1, "L01", 123, "two"), ("b", 2, "L02", 150, "five")]
    with pytest.raises(Exception, match="1 to 200"):
        files.exported(r, chosen, frames, spark.createDataFrame([("b", " ")], "id string, answer string")).collect()


def test_indexes_are_kept_by_fingerprint(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for key in ("x", "x", "y"):
        assert files.cached(spark, f"{tmp_path}/i", key, build).count() == 3
    assert len(built) == 2
    f = spark.createDataFrame([("b", 1, 2), ("a", 1, 2)], "path string, length int, modified int")
    one, two = (f.agg(files.fingerprint("/r", m, "stride=1", f).alias("h")).first().h for m in ("clip", "other"))
    assert len(one) == 20 and one != two
    files.write_index(f, f"{tmp_path}/idx")
    assert files.read_json_lines(spark, f"{tmp_path}/idx", "path string, length int").count() == 2


def test_work_markers_and_manifest(spark):
    videos = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string")
    markers = spark.createDataFrame([("a", 3, "clip", True), ("b", 2, "clip", None), ("c", 2, "old", None)], "video_id string, schema int, model string, all_frames boolean")
    expected = {"schema": 3, "model": "clip"}
    assert [r.video_id for r in preprocess.work_list(videos, markers, expected).orderBy("video_id").collect()] == ["b", "c"]
    assert preprocess.work_list(videos, markers, expected, videos.limit(0)).count() == 3
    raised = {r.video_id: (r.schema, r.migrated_from) for r in preprocess.migrated(markers, expected, 2).collect()}
    assert raised == {"a": (3, None), "b": (3, 2), "c": (2, None)}
    visual = spark.createDataFrame([("a", True, 8)], "video_id string, all_frames boolean, frames long")
    text = spark.createDataFrame([("a", 1), ("b", 4)], "video_id string, records long")
    m = preprocess.manifest(videos, visual, text).first()
    assert (m.videos, m.visual, m.ocr, m.complete, m.all_frames, m.frames, m.records) == (3, 1, 2, 1, 1, 8, 5)
    assert [r.video_id for r in preprocess.repeated_videos(videos.union(videos.limit(1))).collect()] == ["a"]


def test_only_sound_shards_are_read(spark):
    rows = [("a", 0, 0, [1.0]), ("a", 1, 4, [1.0]), ("b", 0, 4, [1.0]), ("b", 1, 4, [1.0]), ("c", 0, 4, [1.0])]
    frames = spark.createDataFrame(rows, "video_id string, feature_index long, frame_id long, embedding array<double>")
    markers = spark.createDataFrame([("a", 3, False, "clip", 2), ("b", 3, False, "clip", 2), ("c", 3, True, "clip", 1)], "video_id string, schema int, stores_frame_images boolean, model string, frames long")
    assert {r.video_id for r in preprocess.sound_shards(frames, markers, "clip").collect()} == {"a"}
    with pytest.raises(ValueError):
        preprocess.sound_shards(frames, markers, "other")
    assert {r.video_id: r.continuous for r in preprocess.valid_shards(frames).collect()} == {"a": False, "b": False, "c": False}
    s = preprocess.by_source(frames.select("video_id", F.col("frame_id"))).withColumn("p", F.spark_partition_id()).collect()
    assert len({r.p for r in s if r.video_id == "a"}) == 1
