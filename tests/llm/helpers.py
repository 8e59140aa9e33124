"""Small tables with the awkward cases of every operator."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def sentence(draw: random.Random, words: int, kinds: int = 4000) -> str:
    return " ".join(f"w{draw.randrange(kinds)}" for _ in range(words))


def awkward_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, copies, near copies, shared passages, periodic and long texts."""
    draw = random.Random(seed)
    base = [sentence(draw, n) for n in (3, 40, 90, 200, 400)]
    passage = sentence(draw, 120)
    near = base[4].split()
    near[50] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (1, base[3]), (2, base[3]), (3, base[4]), (4, " ".join(near)), (5, None), (6, ""), (7, "  \n "), (8, base[0]),
        (9, base[1] + "\n" + passage + "\n" + base[2]), (10, sentence(draw, 60) + "\n" + passage + "\n" + sentence(draw, 5)),
        (11, passage), (12, "na " * 700), (13, "é" * 500 + " ü " + "日本 " * 200), (None, base[2]), (None, None),
        (14, "a\nb\nc\nd"), (15, "x\na\nb\nc\ny"), (16, "a\nb\na\nb"), (17, base[1].upper() + "!! " + base[1]),
        (18, sentence(draw, 6000)), (19, "tab\tand\x1cold\x00mark <|endoftext|> done"), (20, sentence(draw, 30)), (20, sentence(draw, 31)),
    ]
    rows += [(21, "the same row " * 50)] * 3  # repeated rows
    return rows


def documents(spark, texts=None):
    rows = [(i, t, "en", f"s{n % 2}", len(t or "")) for n, (i, t) in enumerate(awkward_texts() if texts is None else texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clashing(docs, *names):
    """The same rows with more columns, named as an operator's own."""
    for name in names:
        docs = docs.selectExpr("*", f"'other' as {name}")
    return docs


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
