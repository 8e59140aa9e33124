"""Question answering over the listing table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblattice.functions.text import LINE_BREAK, text_or_empty
from joblattice.functions.once import once_per_row
from joblattice.operators.enrich import ModelUnavailable, replies_in_batches
from joblattice.operators.search import TOP_K, rank_per_question

# The answer texts.
ANSWER_PREFIX = "Based on the indexed listings: "
NO_LISTINGS = "No relevant listings were found for the query."
ANSWER_LINES = 5


def context_line() -> Column:
    return F.concat(
        F.lit("- "),
        text_or_empty(F.col("title")),
        F.lit(" at "),
        text_or_empty(F.col("company")),
        F.lit(" ("),
        F.array_join(F.coalesce("skills", F.array().cast("array<string>")), ", "),
        F.lit(")"),
    )


def embed_questions(questions: DataFrame, embedder: Callable[[Column], Column]) -> DataFrame:
    """Questions (question_id, question) with their vectors."""
    return questions.withColumn("embedding", embedder(F.col("question")))


def retrieve(questions: DataFrame, listings: DataFrame, k: int = TOP_K) -> DataFrame:
    """Context lines and source urls of the k nearest listings, in rank order, per question.

    ``questions`` holds question_id and embedding; further columns are kept. A question
    without any listing has an empty context.
    """
    ranked = rank_per_question(questions, listings, k)
    described = ranked.join(listings.select("id", "title", "company", "skills", "url"), "id")
    packed = described.groupBy("question_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", context_line().alias("line"), F.col("url")))
        ).alias("found")
    )
    kept = questions.drop("embedding").join(packed, "question_id", "left")
    lines = F.transform("found", lambda f: f["line"])
    urls = F.transform("found", lambda f: f["url"])
    return kept.withColumns(
        {
            "context": F.coalesce(F.array_join(lines, "\n"), F.lit("")),
            "sources": F.coalesce(urls, F.array().cast("array<string>")),
        }
    ).drop("found")


def answer_fallback(context: Column) -> Column:
    """Answer made of the first five context lines."""
    listed = F.filter(F.split(context, LINE_BREAK), lambda line: line.startswith("- "))
    texts = F.transform(listed, lambda line: F.btrim(line, F.lit("- ")))
    return F.when(F.size(listed) == 0, F.lit(NO_LISTINGS)).otherwise(
        F.concat(F.lit(ANSWER_PREFIX), F.array_join(F.slice(texts, 1, ANSWER_LINES), "; "))
    )


def answer_with(
    question: Column,
    context: Column,
    load_model: Callable[[], Callable[[list], list]],
    batch_size: int = 32,
) -> Column:
    """Answers of a model over (question, context) pairs.

    A ``ModelUnavailable`` failure gives the fallback answer; any other fails the job.
    """

    @once_per_row(T.StringType())
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load_model()
        for questions, contexts in batches:
            pairs = list(zip(questions, contexts))
            yield pd.Series(
                [_answer(produce) for produce in replies_in_batches(pairs, model, batch_size)],
                dtype="object",
            )

    return F.coalesce(ask(question, context), answer_fallback(context))


def _answer(produce: Callable[[], str]) -> str | None:
    try:
        return produce().strip()
    except ModelUnavailable:
        return None


def answer_questions(
    questions: DataFrame,
    listings: DataFrame,
    embedder: Callable[[Column], Column],
    load_model: Callable[[], Callable[[list], list]] | None = None,
    k: int = TOP_K,
) -> DataFrame:
    """question_id, question, answer and sources for (question_id, question) rows."""
    found = retrieve(embed_questions(questions, embedder), listings, k)
    if load_model is None:
        answer = answer_fallback(F.col("context"))
    else:
        answer = answer_with(F.col("question"), F.col("context"), load_model)
    return found.select("question_id", "question", answer.alias("answer"), "sources")
