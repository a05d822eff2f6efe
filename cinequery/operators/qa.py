"""Questions about found moments: their kind, answers in one form, consensus over answers, the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import Scratch
from .evaluation import NUMBERS

# Fixed patterns of questions and answers.
QUESTION = r"(?isu)^(.*?)(?:câu\s*hỏi|question)\s*[:\-]\s*(.+)$"
MARKED = r"(?isu)(?:câu\s*hỏi|question)\s*[:\-]\s*"
COUNT = r"(?iu)(?U)\b(?:bao\s*nhiêu|bao\s*nhieu|how\s*many|number\s+of|count|số\s*lượng|so\s*luong|dem\s*so)\b"
HOLDING = r"(?iu)(?U)\b(?:cầm|cam|holding|hold|carrying|carry|nắm|nam)\b|\bwhat\s+is\s+.+\s+holding\b"
APPEARANCE = r"(?iu)(?U)\b(?:màu|mau|color|colour|mặc|mac|wearing|áo|ao)\b"
ANSWER_MARK = r"(?iu)^(?:answer|đáp\s*án)\s*[:\-]\s*"
HOLDER = r"(?i)^(?:the\s+)?(?:red[- ]shirt(?:ed)?\s+)?(?:person|man|woman)\s+(?:is\s+)?(?:holding|carrying)\s+"
ARTICLE = r"(?i)^(?:a|an|the)\s+"
#: Fixed: what an answerer is told, by kind of question.
PROMPT = (
    "Inspect the entire visible scene and answer only from visual evidence. Ignore TV lower-thirds, scrolling tickers, subtitles, logos, clocks, and words on presentation slides. "
    "Do not infer from the event description or common sense. Return only the shortest direct answer. "
)
KIND_PROMPTS = {
    "count": "This is a counting question: count distinct, clearly visible instances of the requested subject in the scene, not people or objects printed on a screen, poster, or photograph. "
    "Return one Arabic integer only; if the subject cannot be seen clearly, return 0. ",
    "holding": "This asks what a person is holding: first locate the person using the clothing/color clue, then inspect the hands. "
    "Return only the object name; if no object is visibly held, return 'nothing' or 'unclear', never an inferred activity. ",
    "appearance": "Answer the requested visible color or clothing attribute, not a background object. ",
}
RANK_DISCOUNT = 0.10
ANSWERED = 8


def split(text: str) -> Column:
    """(event, question, problem): parted at the marker; without one both are the whole text.

    problem is "empty" for blank or null text and "half" if the marker leaves a side empty.
    """
    whole = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\r"))

    def parted(t: Column) -> Column:
        marked = t.rlike(QUESTION)
        event = F.when(marked, F.btrim(F.regexp_extract(t, QUESTION, 1), F.lit(" .:-\n"))).otherwise(t)
        question = F.when(marked, F.btrim(F.regexp_extract(t, QUESTION, 2), F.lit(" \t\n\r"))).otherwise(t)
        # a marker with nothing behind it does not match the pattern of a whole question
        problem = F.when(t == "", "empty").when(marked & ((event == "") | (question == "")), "half").otherwise("")
        return F.struct(event.alias("event"), question.alias("question"), problem.alias("problem"))

    return X.once(whole, parted)


def question_kind(question: str) -> Column:
    q = F.coalesce(F.col(question), F.lit(""))
    return F.when(q.rlike(COUNT), "count").when(q.rlike(HOLDING), "holding").when(q.rlike(APPEARANCE), "appearance").otherwise("general")


def prompt(question: str) -> Column:
    kind = question_kind(question)
    more = F.lit("")
    for k, t in KIND_PROMPTS.items():
        more = F.when(kind == k, t).otherwise(more)
    return F.concat(F.lit(PROMPT), more, F.lit("Question: "), F.coalesce(F.col(question), F.lit("")))


def normal_answer(answer: str, kind: str) -> Column:
    """An answer without its mark; counts as digits, held things without subject and article; nothing is "unknown"."""
    clean = F.btrim(F.regexp_replace(F.coalesce(F.col(answer), F.lit("")), ANSWER_MARK, ""), F.lit(" \t\n\r"))
    table = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])

    def judged(c: Column) -> Column:
        digits = F.regexp_extract(c, r"(?U)\b\d+\b", 0)
        named = F.filter(F.transform(X.words_of(X.normalize(c)), lambda w: F.try_element_at(table, w)), lambda n: n.isNotNull())
        counted = F.when(digits != "", digits).when(F.size(named) > 0, F.get(named, F.lit(0))).otherwise(c)
        held = F.regexp_replace(F.btrim(F.regexp_replace(c, HOLDER, ""), F.lit(" .,:;")), ARTICLE, "")
        out = F.when(F.col(kind) == "count", counted).when(F.col(kind) == "holding", held).otherwise(c)
        return F.when(out == "", "unknown").otherwise(out)

    return X.once(clean, judged)


def token_confidence(probabilities: str) -> Column:
    """The geometric mean of token probabilities, each 1e-8 at least; none give 0."""
    logs = F.aggregate(probabilities, F.lit(0.0), lambda s, p: s + F.log(F.greatest(p.cast("double"), F.lit(1e-8))))
    return F.when(F.size(probabilities) > 0, F.exp(logs / F.size(probabilities))).otherwise(0.0)


def consensus(predictions: DataFrame) -> DataFrame:
    """Of the predictions (query_id, rank, answer, confidence, kind) of each query the answer with most confidence, discounted by rank.

    Rows (query_id, answer, support, confidence): answers agree if their normal
    forms do; the answer is its first wording, confidence the best of those that
    agree; ties go to the answer seen first.
    """
    p = predictions.withColumn("key", F.lower(normal_answer("answer", "kind")))
    worth = F.col("confidence") / (1 + RANK_DISCOUNT * F.greatest(F.col("rank") - 1, F.lit(0)))
    s = p.groupBy("query_id", "key").agg(F.sum(worth).alias("support"), F.min("rank").alias("first"), F.min_by("answer", "rank").alias("answer"), F.max("confidence").alias("confidence"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("support", 9)), "first"))
    return s.withColumn("_n", best).filter("_n = 1").select("query_id", "answer", "support", "confidence")


def filled(results: DataFrame, predictions: DataFrame) -> DataFrame:
    """Results (query_id, rank, ..) with answer and qa_confidence: the prediction of their rank, else the query's consensus; null without any."""
    own = predictions.select("query_id", "rank", F.when(F.col("answer") != "", F.col("answer")).alias("_a"), F.col("confidence").alias("_c"))
    agreed = consensus(predictions).select("query_id", F.col("answer").alias("_ca"), F.col("confidence").alias("_cc"))
    out = results.join(own, ["query_id", "rank"], "left").join(agreed, "query_id", "left")
    return out.withColumn("answer", F.coalesce("_a", "_ca")).withColumn("qa_confidence", F.when(F.col("_a").isNotNull(), F.col("_c")).otherwise(F.col("_cc"))).drop("_a", "_c", "_ca", "_cc")


def retrieval_query(event: Column, question: Column) -> Column:
    """What retrieval searches for: the event, and the question if it says something else."""
    return F.when(F.lower(event) == F.lower(question), event).otherwise(F.concat(event, F.lit("\nVisual question: "), question))


def answered(queries: DataFrame, search: Callable[[DataFrame], DataFrame], answer: Callable[[DataFrame], DataFrame], most: int = ANSWERED) -> DataFrame:
    """Answers of questions (query_id, query): split, search, answer the first `most` results, fill the rest by consensus.

    `search` takes (query_id, query) and returns ranked results; `answer` takes
    results with question and kind and adds (answer, confidence). Queries that
    cannot be split take no part. Results and predictions are written to the
    shared folder, as each is read more than once.
    """
    scratch = Scratch(queries.sparkSession, "answers")
    parts = queries.select("query_id", split("query").alias("p")).filter("p.problem = ''").select("query_id", "p.event", "p.question").withColumn("kind", question_kind("question"))
    results = scratch.write(search(parts.select("query_id", retrieval_query(F.col("event"), F.col("question")).alias("query"))), "results")
    asked = results.filter(F.col("rank") <= min(max(most, 1), 12)).join(parts.select("query_id", "question", "kind"), "query_id")
    predictions = answer(asked).select("query_id", "rank", "kind", normal_answer("answer", "kind").alias("answer"), "confidence")
    return filled(results, scratch.write(predictions, "predictions"))
