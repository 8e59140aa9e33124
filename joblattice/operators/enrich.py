"""Skills and confidence: the dictionary rule, and the hook for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblattice.functions.text import text_or_empty
from joblattice.functions.once import computed_once, once_per_row

# The skill dictionary, the role words and the three confidence levels.
SKILLS = (
    "python",
    "java",
    "javascript",
    "typescript",
    "react",
    "node",
    "sql",
    "aws",
    "docker",
    "kubernetes",
    "llm",
    "nlp",
    "fastapi",
    "scrapy",
    "postgresql",
    "machine learning",
)
ROLE_WORDS = ("engineer", "developer", "backend", "frontend", "full stack", "software")
WITH_SKILLS, ROLE_ONLY, NEITHER = 0.8, 0.75, 0.45

_SEPARATOR = "\x01"


def _lowered(description: Column) -> Column:
    return F.lower(text_or_empty(description))


def _skills_in(text: Column, skills: Sequence[str]) -> Column:
    terms_of: dict[str, list[str]] = {}
    for term in skills:
        terms_of.setdefault(term.title() if term.islower() else term, []).append(term)
    hits = []
    for title in sorted(terms_of):
        found = F.lit(False)
        for term in terms_of[title]:
            found = found | text.contains(term)
        hits.append(F.when(found, F.lit(title)))
    line = F.concat_ws(_SEPARATOR, *hits)
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, _SEPARATOR))


def extract_skills(description: Column, skills: Sequence[str] = SKILLS) -> Column:
    """Dictionary terms found in the text, as distinct titles in code-point order.

    The dictionary is sorted and merged by title up front, so the per-row work is one
    lower() and a ``contains`` per term, all of it inside generated code.
    """
    return _skills_in(_lowered(description), skills)


def role_word_pattern(words: Sequence[str]) -> str:
    """Whole-word match where letters and digits of any script, and ``_``, make words."""
    alternatives = "|".join(words)
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{alternatives})(?![\p{{L}}\p{{N}}_])"


def _confidence(skills: Column, text: Column, role_words: Sequence[str]) -> Column:
    # A plain substring search spares most texts the pattern.
    mentioned = F.lit(False)
    for word in role_words:
        mentioned = mentioned | text.contains(word)
    return (
        F.when(F.size(skills) > 0, F.lit(WITH_SKILLS))
        .when(mentioned & text.rlike(role_word_pattern(role_words)), F.lit(ROLE_ONLY))
        .otherwise(F.lit(NEITHER))
    )


def score_confidence(
    skills: Column, description: Column, role_words: Sequence[str] = ROLE_WORDS
) -> Column:
    return _confidence(skills, _lowered(description), role_words)


def enrich(
    rows: DataFrame, skills: Sequence[str] = SKILLS, role_words: Sequence[str] = ROLE_WORDS
) -> DataFrame:
    """Add skills, confidence and an (always null) error; each text is scanned once."""
    lowered = computed_once(rows, _text=_lowered(F.col("description")))
    tagged = computed_once(lowered, skills=_skills_in(F.col("_text"), skills))
    scored = computed_once(
        tagged, confidence=_confidence(F.col("skills"), F.col("_text"), role_words)
    )
    return scored.drop("_text").withColumn("error", F.lit(None).cast("string"))


class ModelUnavailable(Exception):
    """Raise it from a model function for a transport failure: the dictionary rule applies."""


_REPLY = T.StructType([T.StructField("text", T.StringType()), T.StructField("problem", T.StringType())])


def _outcome(produce: Callable[[], str]) -> tuple[str | None, str | None]:
    """The reply's text, or the problem in its place; neither where the dictionary rule has to step in."""
    try:
        return produce(), None
    except (ModelUnavailable, KeyError, ValueError):
        return None, None
    except Exception as problem:  # any other failure is recorded and scores zero
        return None, str(problem)


def with_reply(rows: DataFrame) -> DataFrame:
    """Add ``_skills`` and ``_confidence`` read from the JSON object in ``_reply.text``.

    Both are null where the reply is no object, its skills no list or its confidence no number;
    what the object leaves out is an empty list or zero.
    """
    parsed = rows.withColumn("_parsed", F.try_parse_json("_reply.text"))

    def part(path: str, kind: str) -> Column:
        return F.try_variant_get("_parsed", path, kind)

    names = F.transform(part("$.skills", "array<variant>"), lambda skill: F.btrim(F.try_variant_get(skill, "$", "string")))
    listed = F.when(part("$.skills", "variant").isNull(), F.array().cast("array<string>")).otherwise(F.filter(names, lambda n: n != ""))
    number = F.when(part("$.confidence", "variant").isNull(), F.lit(0.0)).otherwise(part("$.confidence", "double"))
    usable = part("$", "map<string,variant>").isNotNull() & listed.isNotNull() & number.isNotNull()
    return computed_once(parsed, _skills=F.when(usable, listed), _confidence=F.when(usable, number)).drop("_parsed")


def replies_in_batches(
    texts: list, model: Callable[[list], list], batch_size: int
) -> Iterator[Callable[[], str]]:
    """One thunk per text, giving its reply or raising its failure.

    A failed batch is asked again text by text, so one bad text fails alone.
    """
    for start in range(0, len(texts), batch_size):
        batch = texts[start : start + batch_size]
        try:
            replies = model(batch)
            if len(replies) != len(batch):
                raise RuntimeError("the model gave a wrong number of replies")
        except Exception:
            for text in batch:
                yield lambda text=text: model([text])[0]
        else:
            for reply in replies:
                yield lambda reply=reply: reply


def enrich_with(
    rows: DataFrame,
    load_model: Callable[[], Callable[[list], list]],
    batch_size: int = 32,
    skills: Sequence[str] = SKILLS,
    role_words: Sequence[str] = ROLE_WORDS,
) -> DataFrame:
    """Add skills, confidence and error from a model's JSON replies.

    ``load_model`` runs once per Python worker task and gives a function from a list of
    descriptions to a list of reply texts. Only the description crosses to Python.
    """

    @once_per_row(_REPLY)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for texts in batches:
            yield pd.DataFrame(
                [_outcome(p) for p in replies_in_batches(texts.fillna("").tolist(), model, batch_size)],
                columns=_REPLY.fieldNames(),
            )

    described = F.col("description")
    failed = F.col("_reply.problem").isNotNull()
    no_skills = F.array().cast("array<string>")
    asked = with_reply(rows.withColumn("_reply", ask(described)))
    unanswered = ~failed & F.col("_skills").isNull()
    return (
        asked.withColumn(
            "skills",
            F.when(failed, no_skills).when(unanswered, extract_skills(described, skills)).otherwise(F.col("_skills")),
        )
        .withColumn(
            "confidence",
            F.when(failed, F.lit(0.0))
            .when(unanswered, score_confidence(F.col("skills"), described, role_words))
            .otherwise(F.col("_confidence")),
        )
        .withColumn(
            "error",
            F.when(
                F.col("_reply.problem").isNotNull(),
                F.concat(
                    F.lit("enrich:"), text_or_empty(F.col("url")), F.lit(":"), F.col("_reply.problem")
                ),
            ),
        )
        .drop("_reply", "_skills", "_confidence")
    )
