"""Query text to evidence sources: clauses, scores of four modalities, a query for each source.

Everything is an expression over one row: clauses live in an array, so that no
step moves data between executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

MODALITIES = ("visual", "ocr", "metadata", "object")
# Cue words of each source, as folded text; a cue counts wherever it occurs.
OCR_CUES = (
    "noi dung", "dong chu", "chu viet", "ghi gi", "viet gi", "doc chu", "van ban", "bien bao", "bang hieu", "phu de", "tieu de tren", "tai lieu", "logo", "nhan hieu",
    "bien so", "man hinh hien", "text", "written", "word", "words", "says", "sign", "banner", "subtitle", "caption", "document", "license plate",
)
METADATA_CUES = (
    "ten video", "tieu de video", "ten chuong trinh", "chuong trinh nao", "kenh nao", "kenh truyen hinh", "ngay phat", "metadata", "video title", "program title", "channel",
    "broadcast date", "description", "keyword", "episode", "dia diem", "location",
)
OBJECT_CUES = (
    "bao nhieu", "dem so", "mau gi", "mau nao", "mac ao", "cam vat", "vat gi", "do vat", "phuong tien", "con vat", "how many", "what color", "which color",
    "wearing", "holding", "object", "vehicle", "animal", "count", "so luong",
)
VISUAL_CUES = (
    "dang lam", "hanh dong", "khoanh khac", "canh", "di bo", "chay", "nhay", "ngoi", "dung", "noi chuyen", "phat bieu", "trao", "mo", "dong", "roi", "what happens",
    "action", "scene", "moment", "walking", "running", "jumping", "speaking", "opening",
)
WARNING_CUES = ("canh bao", "nguy hiem", "sat lo", "lu quet", "warning", "landslide")
#: Fixed: what every modality has, and what pictures and objects have besides.
BASE, VISUAL_MORE, OBJECT_MORE = 0.08, 0.45, 0.18
#: Fixed: per modality its first score, its cues, the worth of a cue and the most that cues add.
EVIDENCE = {
    "visual": (BASE + VISUAL_MORE, VISUAL_CUES, 0.45, 1.4),
    "ocr": (BASE, OCR_CUES, 0.80, 1.6),
    "metadata": (BASE, METADATA_CUES, 0.90, 1.8),
    "object": (BASE + OBJECT_MORE, OBJECT_CUES, 0.90, 1.8),
}
#: Fixed phrases after which a sentence quotes visible text.
CONNECTOR = r"\b(?:có\s+nội\s+dung(?:\s+là)?|nội\s+dung(?:\s+là)?|có\s+chữ|chứa\s+(?:dòng\s+)?chữ|ghi(?:\s+là)?|viết(?:\s+là)?|says?|with\s+(?:the\s+)?(?:text|words?)|containing\s+(?:the\s+)?(?:text|words?))\b"
#: Fixed characters that are no part of a clause's ends.
EDGE = " ,:-—–"
#: Fixed lines that number events; group 1 is the number, group 2 the text.
EVENT_LINE = r"^\s*(?:[-*•]\s*)?(?:sự\s*kiện|su\s*kien|event)\s*(\d+)\s*(?:[—–:]|-|\.)\s*(.+?)\s*$"
NUMBERED_LINE = r"^\s*(?:[-*•]\s*)?(\d+)\s*[.)\-:]\s*(.+?)\s*$"


def clauses(text: str) -> Column:
    """Array of (text, role): sentences cut at connectors, what follows the last connector has role "ocr".

    Null or blank text gives an empty array; text of marks alone is one clause.
    """
    raw = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " "))

    def pieces(sentence: Column) -> Column:
        parts = F.split(F.regexp_replace(sentence, f"(?iU){CONNECTOR}", "\u0001"), "\u0001")
        return F.transform(parts, lambda p, i: F.struct(F.btrim(p, F.lit(EDGE)).alias("text"), F.when((F.size(parts) > 1) & (i == F.size(parts) - 1), "ocr").otherwise("").alias("role")))

    found = F.filter(F.flatten(F.transform(F.split(raw, r"[.!?;\n]+"), pieces)), lambda c: c.text != "")
    whole = F.array(F.struct(raw.alias("text"), F.lit("").alias("role")))
    return F.when((F.size(found) == 0) & (raw != ""), whole).otherwise(found)


def cue_count(text: Column, cues: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cues)), lambda c: F.contains(text, c)))


def physical_sign(folded: Column) -> Column:
    """A sign and a colour: what a frame looks like, not what is written in it."""
    return F.contains(folded, F.lit("bien")) & (F.contains(folded, F.lit("mau")) | F.contains(folded, F.lit("yellow")))


def normalised(scores: list[Column], floor: float = 0.02) -> list[Column]:
    bounded = [F.greatest(F.lit(floor), s) for s in scores]
    total = sum(bounded[1:], bounded[0])
    return [b / total for b in bounded]


def softmax(values: list[Column], temperature: float = 0.18) -> list[Column]:
    top = F.greatest(*values)
    powers = [F.exp((v - top) / max(0.02, temperature)) for v in values]
    return [p / sum(powers[1:], powers[0]) for p in powers]


def _fields(values: list[Column]) -> Column:
    return F.struct(*[v.alias(m) for m, v in zip(MODALITIES, values, strict=True)])


def _each(s: Column) -> list[Column]:
    return [s[m] for m in MODALITIES]


MODEL_SHARE, LEXICAL_SHARE, DAMPED = 0.68, 0.32, 0.08  # fixed


def scored_clauses(found: str, model: str | None = None) -> Column:
    """Array of (text, role, folded, scores, dominant, confidence, mass) from `clauses`.

    `model` names an array with a model's similarities of each clause, one
    struct of the four modalities a clause in the same order; `softmax` makes
    shares of them. Without a model the lexical scores stand in for it. Both are
    mixed 0.68 to 0.32 and a role damps the other modalities. Each step is a
    transform of its own, so that what it names is evaluated once.
    """
    step = F.transform(found, lambda c: F.struct(c.text.alias("text"), c.role.alias("role"), X.squeezed(c.text).alias("folded"), F.greatest(F.lit(1), F.size(F.regexp_extract_all(c.text, F.lit(r"(?U)(\w+)"), 1))).alias("mass")))

    def lexical(c: Column) -> Column:
        sign = physical_sign(c.folded)
        raw = {m: F.lit(base) + F.least(F.lit(most), worth * cue_count(c.folded, cues)) for m, (base, cues, worth, most) in EVIDENCE.items()}
        raw["visual"] += F.when(sign, 1.0).otherwise(0.0)
        raw["ocr"] = raw["ocr"] * F.when(sign, 0.55).otherwise(1.0) + F.when(c.role == "ocr", 2.4).otherwise(0.0)
        return F.struct(*[c[x].alias(x) for x in ("text", "role", "folded", "mass")], _fields([raw[m] for m in MODALITIES]).alias("lexical"))

    def mixed(c: Column, i: Column) -> Column:
        part = normalised(_each(c.lexical))
        known = softmax(_each(F.get(F.col(model), i))) if model else part
        damped = [(MODEL_SHARE * k + LEXICAL_SHARE * p) * F.when((c.role == "ocr") & F.lit(m != "ocr"), DAMPED).otherwise(1.0) for m, k, p in zip(MODALITIES, known, part, strict=True)]
        return F.struct(*[c[x].alias(x) for x in ("text", "role", "folded", "mass")], _fields(normalised(damped)).alias("scores"))

    def judged(c: Column) -> Column:
        scores = _each(c.scores)
        falling = F.array_sort(F.array(*[-s for s in scores]))
        leader = F.when(c.role != "", c.role).when(physical_sign(c.folded), "visual")
        for m, s in zip(MODALITIES, scores, strict=True):
            leader = leader.when(s == F.greatest(*scores), m)
        return F.struct(*[c[x].alias(x) for x in ("text", "role", "folded", "mass", "scores")], leader.alias("dominant"), (falling[1] - falling[0]).alias("confidence"))

    return F.transform(F.transform(F.transform(step, lexical), mixed), judged)


def weights(scored: str) -> Column:
    """Scores of all clauses, weighted by their tokens, as one struct of four weights that sum to 1; null without clauses."""
    c = F.col(scored)
    total = F.aggregate(c, F.lit(0), lambda s, x: s + x.mass)

    def weighed(m: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x.mass / total * x.scores[m])

    return F.when(F.size(c) > 0, _fields(normalised([weighed(m) for m in MODALITIES])))


def query_for(scored: str, modality: str) -> Column:
    """The clauses that count as evidence of one modality, each text once, in order."""

    def include(c: Column) -> Column:
        warning = F.exists(F.array(*map(F.lit, WARNING_CUES)), lambda w: F.contains(c.folded, w))
        strong = (c.scores[modality] >= 0.20) & (c.scores[modality] >= F.greatest(*_each(c.scores)) - 0.12)
        return F.when(c.role != "", c.role == modality).when(physical_sign(c.folded), F.lit(modality == "visual")).when(warning & F.lit(modality == "ocr"), F.lit(True)).otherwise(strong)

    return F.array_join(F.array_distinct(F.transform(F.filter(scored, include), lambda c: c.text)), " ")


def explicit_ocr(text: str) -> Column:
    """Does the query ask for visible text: by a cue, a quotation, or a run of capitals (accented letters of either case count as such)?"""
    quoted = F.col(text).rlike("[\"“”'][^\"“”']{3,}[\"“”']")
    capitals = F.col(text).rlike(r"(?U)\b[A-ZÀ-ỸĐ][A-ZÀ-ỸĐ\s]{5,}\b")
    return F.coalesce((cue_count(X.squeezed(text), OCR_CUES) > 0) | quoted | capitals, F.lit(False))


def events(text: str, least: int = 2, most: int = 12) -> Column:
    """(events, problem): the texts of numbered event lines by number, else of numbered lines, else all lines without bullets.

    `problem` is "duplicate", "few", "many" or empty; null text has no lines.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n"), F.trim), lambda x: x != "")

    def numbered(pattern: str) -> Column:
        row = lambda x: F.struct(F.regexp_extract(x, pattern, 1).cast("long").alias("number"), F.btrim(F.regexp_extract(x, pattern, 2), F.lit(" \t:-—–")).alias("body"))
        return F.filter(F.transform(F.filter(lines, lambda x: x.rlike(pattern)), row), lambda e: e.body != "")

    explicit = numbered(f"(?iu){EVENT_LINE}")
    chosen = F.when(F.size(explicit) > 0, explicit).otherwise(numbered(NUMBERED_LINE))
    bodies = F.when(F.size(chosen) > 0, F.transform(F.array_sort(chosen), lambda e: e.body)).otherwise(F.transform(lines, lambda x: F.trim(F.ltrim(x, F.lit("-*• ")))))
    repeated = F.size(F.array_distinct(F.transform(chosen, lambda e: e.number))) < F.size(chosen)
    problem = F.when(repeated, "duplicate").when(F.size(bodies) < least, "few").when(F.size(bodies) > most, "many").otherwise("")
    return F.struct(bodies.alias("events"), problem.alias("problem"))
