"""Small functions of query text and of shown results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import router

#: Fixed words that hint at Vietnamese without accents.
VIETNAMESE_HINTS = (
    "anh", "bao", "cai", "canh", "cau", "co", "cua", "dang", "duoc", "gi", "hay", "hinh", "khong", "mau", "mot", "nguoi", "nhieu", "o", "the", "tim", "trong", "tren", "vao", "voi", "xe",
)
#: Fixed cues of a warning that may be seen or read.
AMBIGUOUS_CUES = ("canh bao", "nguy hiem", "sat lo", "lu quet", "warning", "dangerous", "landslide")
#: Fixed phrases of a landing.
LANDING = ("tiếp đất", "tiep dat", "tiếp xúc", "tiep xuc", "mặt đất", "mat dat", "landing", "lands", "contact the ground")
#: Fixed texts at the ends of a sequence.
NO_PREVIOUS, NO_NEXT = "none; this is the first stage", "none; this is the final stage"


def looks_vietnamese(text: str) -> Column:
    """Any accented letter (a letter that folds to another, or a combining mark), else two hint words. Null is not."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hints = F.array(*map(F.lit, VIETNAMESE_HINTS))
    words = F.array_distinct(X.words_of(low))
    return (X.normalize(low) != low) | (F.size(F.array_intersect(words, hints)) >= 2)


def for_model(queries: DataFrame, translate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`queries` (.., query) with language, text_for_model and translated. `translate` adds a column english to (query); without it, or without its answer, the text stays."""
    tagged = queries.withColumn("language", F.when(looks_vietnamese("query"), "vi").otherwise("en"))
    if translate is None:
        return tagged.withColumn("text_for_model", F.col("query")).withColumn("translated", F.lit(False))
    known = translate(tagged.filter("language = 'vi'").select("query").distinct()).select("query", "english")
    out = tagged.join(known, "query", "left").withColumn("text_for_model", F.coalesce("english", "query"))
    return out.withColumn("translated", F.col("english").isNotNull()).drop("english")


def ambiguous_warning(text: str) -> Column:
    """A warning is named, but not asked for as visible text."""
    return ~router.explicit_ocr(text) & (router.cue_count(X.squeezed(F.coalesce(F.col(text), F.lit(""))), AMBIGUOUS_CUES) > 0)


def landing(text: str) -> Column:
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.exists(F.array(*map(F.lit, LANDING)), lambda t: F.contains(low, t))


def in_sequence(events: DataFrame, query: str = "query_id", event: str = "event", place: str = "place") -> DataFrame:
    """Events (query, place 0.., event) with the text that a pair scorer reads: the stage, the one before and the one after."""
    w = Window.partitionBy(query).orderBy(place)
    n = F.count("*").over(Window.partitionBy(query))
    before, after = F.lag(event, 1).over(w), F.lead(event, 1).over(w)
    text = F.format_string("Ordered event %d/%d. Exact stage: %s\nPrevious stage: %s\nNext stage: %s", F.col(place) + 1, n, F.col(event), F.coalesce(before, F.lit(NO_PREVIOUS)), F.coalesce(after, F.lit(NO_NEXT)))
    return events.withColumn("stage", text)


def time_label(seconds: Column) -> Column:
    """mm:ss.sss; negative times are 0."""
    s = F.greatest(seconds, F.lit(0.0))
    minutes = F.floor(s / 60)
    return F.format_string("%02d:%06.3f", minutes, s - minutes * 60)


def shown(*columns: str, places: int = 3) -> list[Column]:
    """The columns, rounded half to even, as results are shown."""
    return [F.bround(c, places).alias(c) for c in columns]


def caption() -> Column:
    """The text below a result (rank, video_id, frame_id, pts_time, score, title, labels, answer, qa_confidence)."""
    labels = F.array_join(F.slice("labels", 1, 6), ", ")
    answer = F.when(F.coalesce("answer", F.lit("")) != "", F.format_string("\nQ&A: %s (%.0f%%)", F.col("answer"), F.col("qa_confidence") * 100)).otherwise("")
    head = F.format_string("#%d | %s.mp4 | frame %d | %.2fs | score %.4f\n%s\nObjects: %s", "rank", "video_id", "frame_id", "pts_time", "score", "title", F.when(labels == "", "no object metadata").otherwise(labels))
    return F.concat(head, answer)


def table_row(results: DataFrame) -> DataFrame:
    """Results as rows of a table, scores to five places, the first eight labels joined."""
    rounded = shown("visual", "metadata", "score", places=5)
    return results.select("rank", "video_id", "frame_id", "keyframe_number", *shown("pts_time"), *rounded, "title", F.array_join(F.slice("labels", 1, 8), ", ").alias("labels"))
