"""Offline preparation: sampling, overlay boxes, text quality, object matrices, shard checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Fixed phrases that mark a scrolling news line in old records.
TICKER_PATTERNS = (
    r"\bnguy\s+c[oa]\b",
    r"\bl[uo]?\s+quet\b",
    r"\bv(?:u)?ng\s+nui\b",
    r"\bmien\s+bac\b",
    r"\bmua\s+lon\s+dai\s+nga(?:y)?\b",
    r"\btrung\s+du\b",
    r"\bbac\s+bo\b",
    r"\btrung\s+bo\b",
    r"\bnam\s+bo\b",
    r"\btheo\s+du\s+bao\b",
    r"\bkhu\s+vuc\b",
    r"\btren\s+dia\s+ban\b",
    r"\bthoi\s+tiet\b",
    r"\btin\s+moi\s+nhat\b",
)


def sampled_frame(frame: str, source_fps: float, sample_fps: float) -> Column:
    """Whether a frame is the first of its sampling interval (closed form of the accumulating sampler)."""
    source = source_fps if source_fps > 0 else 30.0
    if sample_fps <= 0 or sample_fps >= source:
        return F.lit(True)
    every = source / sample_fps
    f = F.col(frame).cast("double")
    return (F.col(frame) == 0) | (F.floor((f + 1e-6) / every) > F.floor((f - 1 + 1e-6) / every))


def estimated_samples(frames: Column, source_fps: float, sample_fps: float) -> Column:
    return F.when(frames <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(frames * sample_fps / source_fps)))


# Fixed values of the quality of old records: two or three phrases, and what they leave.
FEW_PHRASES, FEW_QUALITY, MANY_PHRASES, MANY_QUALITY = 2, 0.12, 3, 0.05
SCENE_SCHEMA = 2  # fixed: the first schema that keeps overlays apart
#: Any of the phrases; each begins at a word's edge, which is looked for once a place.
ANY_TICKER = r"\b(?=[klmnbtv])(?:" + "|".join(p.removeprefix(r"\b") for p in TICKER_PATTERNS) + ")"


def legacy_quality(text: str, schema: str) -> Column:
    """Trust in a record without boxes: warning signs 1, several news phrases little. Newer schemas are not read; null text is trusted.

    White space is not collapsed: the phrases allow any, and signs are read without it.
    """

    def judged(plain: Column) -> Column:
        compact = F.regexp_replace(plain, r"(?U)\W+", "")
        sign = F.contains(compact, F.lit("canhbao")) & F.contains(compact, F.lit("satlo")) & compact.rlike("nguyi?hiem")
        hits = sum((plain.rlike(p).cast("int") for p in TICKER_PATTERNS), F.lit(0))
        graded = X.once(hits, lambda n: F.when(n >= MANY_PHRASES, MANY_QUALITY).when(n >= FEW_PHRASES, FEW_QUALITY).otherwise(1.0))
        # most texts hold no phrase at all: one pass tells
        return F.when(~plain.rlike(ANY_TICKER), 1.0).when(sign, 1.0).otherwise(graded)

    return F.when(F.col(schema) >= SCENE_SCHEMA, 1.0).otherwise(F.coalesce(X.once(X.normalize(text), judged), F.lit(1.0)))


def record_quality(quality: Column, automatic: Column) -> Column:
    """The lesser of a record's own quality and the automatic one, within 0 .. 1."""
    return X.clip(F.least(quality, automatic))


TRUSTED_QUALITY = 0.50  # fixed: records below it lend no text


def trusted_text(text: str, quality: str, schema: str) -> Column:
    """The text of records that are trusted and keep overlays apart, else nothing."""
    return F.when((F.col(quality) >= TRUSTED_QUALITY) & (F.col(schema) >= SCENE_SCHEMA), F.coalesce(F.col(text), F.lit(""))).otherwise("")


# Fixed bounds of overlay boxes, as shares of the picture: lines at the bottom, small boxes in upper corners.
BOTTOM_START, BOTTOM_HEIGHT, BOTTOM_WIDTH, BOTTOM_CHARS = 0.82, 0.14, 0.10, 6
CORNER_END, CORNER_LEFT, CORNER_RIGHT, CORNER_HEIGHT, CORNER_WIDTH = 0.20, 0.22, 0.78, 0.12, 0.32


def overlay_box(x0: Column, y0: Column, x1: Column, y1: Column, width: float | Column, height: float | Column, chars: Column, start: float = BOTTOM_START) -> Column:
    """Whether a box is a broadcast overlay: a line at the bottom, or a small one in an upper corner."""
    start = min(max(start, 0.65), 0.95)
    cx, cy, rw, rh = (x0 + x1) / 2 / width, (y0 + y1) / 2 / height, (x1 - x0) / width, (y1 - y0) / height
    bottom = (cy >= start) & (rh <= BOTTOM_HEIGHT) & ((rw >= BOTTOM_WIDTH) | (chars >= BOTTOM_CHARS))
    corner = (cy <= CORNER_END) & ((cx <= CORNER_LEFT) | (cx >= CORNER_RIGHT)) & (rh <= CORNER_HEIGHT) & (rw <= CORNER_WIDTH)
    return bottom | corner


def object_matrix(detections: DataFrame, classes: list[str], threshold: float = 0.20) -> DataFrame:
    """Rows (frame_id, a column for each class): the highest confidence of `threshold` or more, else 0."""
    kept = detections.filter(F.col("confidence") >= threshold)
    return kept.groupBy("frame_id").pivot("label", classes).agg(F.max("confidence")).na.fill(0.0, classes)


#: Fixed: boxes of less confidence are not read.
LEAST_CONFIDENCE = 0.45


def frame_text(boxes: str, width: Column, height: Column, least: float = LEAST_CONFIDENCE, start: float = BOTTOM_START) -> Column:
    """(scene_text, overlay_text, scene_boxes, overlay_boxes) of recognised boxes, array<struct<polygon array<array<double>>, text, confidence>>.

    Boxes of less confidence and blank ones are left out; polygons of fewer
    than two whole points are no overlay. Lines that repeat are told once.
    """

    def bounded(b: Column) -> Column:
        points = F.filter(F.coalesce(b.polygon, F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2)
        whole = (F.size(points) == F.size(b.polygon)) & (F.size(points) >= 2)
        x, y = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
        chars = F.length(F.regexp_replace(b.text, r"(?U)\W+", ""))
        over = overlay_box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y), width, height, chars, start)
        return F.struct(F.btrim(b.text, F.lit(" \t\n\r")).alias("line"), F.coalesce(whole & over & (width > 0) & (height > 0), F.lit(False)).alias("overlay"))

    def told(kept: Column) -> Column:
        scene, over = F.filter(kept, lambda b: ~b.overlay), F.filter(kept, lambda b: b.overlay)
        text = lambda part: F.array_join(F.array_distinct(F.transform(part, lambda b: b.line)), " ")
        return F.struct(text(scene).alias("scene_text"), text(over).alias("overlay_text"), F.size(scene).alias("scene_boxes"), F.size(over).alias("overlay_boxes"))

    read = F.filter(F.coalesce(boxes, F.array().cast("array<struct<polygon:array<array<double>>,text:string,confidence:double>>")), lambda b: (b.confidence >= least) & (F.btrim(b.text, F.lit(" \t\n\r")) != ""))
    return X.once(F.transform(read, bounded), told)


def index_statistics(records: DataFrame) -> DataFrame:
    """One row (records, least_schema, legacy) over text records (schema); an empty index counts as the newest schema."""
    return records.agg(F.count("*").alias("records"), F.coalesce(F.min("schema"), F.lit(SCENE_SCHEMA)).alias("least_schema"), F.count_if(F.col("schema") < SCENE_SCHEMA).alias("legacy"))


def run_counters(frames: DataFrame) -> DataFrame:
    """One row of what a recognition run read, over (scene_text, overlay_text, scene_boxes, overlay_boxes, failed)."""
    scene, over = F.col("scene_text") != "", F.col("overlay_boxes") > 0
    return frames.agg(
        F.count("*").alias("frames"), F.count_if(scene).alias("records"), F.coalesce(F.sum("scene_boxes"), F.lit(0)).alias("scene_lines"), F.coalesce(F.sum("overlay_boxes"), F.lit(0)).alias("overlay_lines"),
        F.count_if(over & ~scene).alias("overlay_only"), F.count_if("failed").alias("failures"),
    )


def repeated_videos(videos: DataFrame) -> DataFrame:
    """The video_ids that occur more than once, and how often."""
    return videos.groupBy("video_id").agg(F.count("*").alias("n")).filter("n > 1")


def offsets(frames: DataFrame) -> DataFrame:
    """(video_id, start, end): each video's rows in a table of all vectors, videos by name, ends exclusive. A row a video is numbered."""
    sizes = frames.groupBy("video_id").agg(F.count("*").alias("n"))
    end = F.sum("n").over(Window.orderBy("video_id"))
    return sizes.select("video_id", (end - F.col("n")).alias("start"), end.alias("end"))


def global_index(shards: DataFrame) -> DataFrame:
    """The text records of all shards that say something, once each keyframe: the newest schema, then the longest text, then the first in order."""
    said = shards.filter(F.btrim("text", F.lit(" \t\n\r")) != "")
    order = F.struct(-F.col("schema"), -F.length("text"), "text")
    return said.groupBy("video_id", "keyframe_number").agg(F.min_by(F.struct("text", "schema"), order).alias("r")).select("video_id", "keyframe_number", "r.text", "r.schema")


def work_list(videos: DataFrame, markers: DataFrame, expected: dict[str, object], required: DataFrame | None = None) -> DataFrame:
    """The videos still to be done: those without a marker (video_id, ..) that equals all of `expected`, or without a row in `required`."""
    same = F.lit(True)
    for name, value in expected.items():
        same &= F.col(name).eqNullSafe(F.lit(value))
    done = markers.filter(same).select("video_id")
    if required is not None:
        done = done.join(required.select("video_id"), "video_id", "left_semi")
    return videos.join(done, "video_id", "left_anti")


def migrated(markers: DataFrame, expected: dict[str, object], old: int, kept: tuple[str, ...] = ("schema", "frame_storage", "stores_frame_images")) -> DataFrame:
    """Markers of the schema before that agree in all else are raised to the expected one; others stay as they are."""
    fits = F.col("schema") == old
    for name, value in expected.items():
        if name not in kept:
            fits &= F.col(name).eqNullSafe(F.lit(value))
    fits = F.coalesce(fits, F.lit(False))
    columns = [F.when(fits, F.lit(expected[c])).otherwise(F.col(c)).alias(c) if c in expected else F.col(c) for c in markers.columns]
    return markers.select(*columns, F.when(fits, F.lit(old)).alias("migrated_from"))


def manifest(videos: DataFrame, visual: DataFrame, text: DataFrame) -> DataFrame:
    """One row of counts over videos (video_id) and the markers of their stages (visual: all_frames, frames; text: records)."""
    v = visual.select("video_id", F.lit(True).alias("_v"), "all_frames", "frames")
    t = text.select("video_id", F.lit(True).alias("_t"), "records")
    j = videos.select("video_id").join(v, "video_id", "left").join(t, "video_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return j.agg(F.count("*").alias("videos"), F.count_if("_v").alias("visual"), F.count_if("_t").alias("ocr"), F.count_if(F.col("_v") & F.col("_t")).alias("complete"), F.count_if("all_frames").alias("all_frames"), total("frames"), total("records"))


def by_source(results: DataFrame) -> DataFrame:
    """Results ordered for a decoder: a video's frames in one partition, in order, so that each file is opened once."""
    return results.repartition("video_id").sortWithinPartitions("video_id", "frame_id")


SHARD_SCHEMA = 3  # fixed


def sound_shards(frames: DataFrame, markers: DataFrame, model: str) -> DataFrame:
    """The frames of videos whose shard is sound and whose marker (video_id, schema, stores_frame_images, model, frames) fits; none at all is an error."""
    fits = markers.filter((F.col("schema") == SHARD_SCHEMA) & ~F.col("stores_frame_images") & (F.col("model") == model)).select("video_id", F.col("frames").alias("_n"))
    sound = valid_shards(frames).filter("sound").join(fits, "video_id").filter("n_frames = _n").select("video_id")
    if sound.limit(1).count() == 0:
        raise ValueError("no sound shard")
    return frames.join(sound, "video_id", "left_semi")


def valid_shards(frames: DataFrame) -> DataFrame:
    """A row for each video: frames, vectors' widths, whether frame numbers rise strictly, whether they miss none from 0 on, and whether the shard is sound."""
    step = F.col("frame_id") - F.lag("frame_id").over(Window.partitionBy("video_id").orderBy("feature_index"))
    stepped = frames.withColumn("_step", step).withColumn("_dim", F.size("embedding"))
    out = stepped.groupBy("video_id").agg(F.count("*").alias("n_frames"), F.min("_dim").alias("min_dim"), F.max("_dim").alias("max_dim"), F.coalesce(F.bool_and(F.col("_step") > 0), F.lit(True)).alias("rising"), (F.coalesce(F.bool_and(F.col("_step") == 1), F.lit(True)) & (F.min("frame_id") == 0)).alias("continuous"), F.count_if(F.col("frame_id") % 4 == 0).alias("n_coarse"))
    return out.withColumn("sound", F.col("rising") & (F.col("min_dim") == F.col("max_dim")) & (F.col("n_coarse") > 0))
