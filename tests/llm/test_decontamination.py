"""Benchmark decontamination against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from helpers import clashing, rows_of, sentence

from joblattice.llm import benchmark_join

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            windows.setdefault(tuple(words[i : i + length]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for length in lengths:
            for i in range(len(words) - length + 1):
                if (w := tuple(words[i : i + length])) in windows:
                    hit.update(range(i, i + length))
                    found |= windows[w]
        listed = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), listed, bool(hit)))
    return sorted(out, key=repr)


def tables(seed=6, short=True):
    draw = random.Random(seed)
    items = [(i, sentence(draw, draw.choice([10, 11, 14, 30, 60]), 300)) for i in range(30)]
    items += [(40, None), (41, " .,\n"), (None, sentence(draw, 12, 300)), (42, items[0][1]), (43, "na " * 13), (7, sentence(draw, 15, 300))]
    items += [(44, f"{items[1][1]} {items[2][1]}"), (45, "É日本 ß 9x " * 4)]
    if short:
        items += [(50, "w1"), (51, "W2, w3"), (52, "w4 w5 w6 w7"), (53, "w8-w9-w10 w11 w12"), (54, sentence(draw, 8, 300)), (55, "w1")]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(draw.randrange(6)):
            words = (draw.choice(items)[1] or "").split()
            start = draw.randrange(max(1, len(words)))
            parts += [sentence(draw, draw.randrange(30), 300), " ".join(words[start : start + draw.randrange(25)]).upper()]
        docs.append((i, draw.choice([" ", ", ", "\n", " - "]).join(parts)))
    docs += [(200, None), (201, ""), (202, "..."), (None, items[3][1]), (None, items[3][1]), (203, "na " * 5000), (203, "NA na " * 9)]
    docs += [(i, f"{sentence(draw, 3)} {items[5][1]} {items[6][1]}") for i in range(300, 380)]  # a hot passage
    return docs, items


@pytest.mark.parametrize("short", [True, False])
@pytest.mark.parametrize("bits", [24, 15])  # a filter that lets nearly all pass changes nothing
def test_equals_brute_force(spark, short, bits):
    docs, items = tables(short=short)
    frame = clashing(spark.createDataFrame(docs, DOCS).repartition(3), "row", "runs", "n_words", "window")
    found = benchmark_join.contamination(frame, clashing(spark.createDataFrame(items, ITEMS), "item", "words", "tokens"), filter_bits=bits)
    assert rows_of(found, *COLUMNS) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = tables()
    nobody, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert benchmark_join.contamination(nobody, spark.createDataFrame(items, ITEMS)).count() == 0
    found = benchmark_join.contamination(spark.createDataFrame(docs[:9], DOCS), nothing)
    assert rows_of(found, *COLUMNS) == brute(docs[:9], [])


def test_clean_documents_stay(spark):
    docs, items = tables()
    kept = benchmark_join.without_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    gone = {r[0] for r in brute(docs, items) if r[-1]}
    assert rows_of(kept, "doc_id", "text") == sorted((d for d in docs if d[0] not in gone), key=repr)


def test_words_of_segments(monkeypatch):
    """Segments of a long text cut no word and change no hash."""
    draw = random.Random(3)
    texts = [sentence(draw, 400), "", "a" * 5000, None or " ", "é" * 900 + " Z", sentence(draw, 7)]
    whole = benchmark_join.Texts(pa.array(["skip", *texts]).slice(1))
    monkeypatch.setattr(benchmark_join, "SEGMENT", 64)
    parted = benchmark_join.Texts(pa.array(texts))
    for name in ("starts", "ends", "first"):
        assert getattr(whole, name).tolist() == getattr(parted, name).tolist()
    assert whole.hashes.tolist() == parted.hashes.tolist()
    for i, text in enumerate(texts):
        assert whole.words(whole.first[i], whole.first[i + 1]) == words_of(text)
