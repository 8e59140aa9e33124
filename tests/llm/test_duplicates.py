"""Near-duplicates, repeated strings and repeated lines against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import awkward_texts, clashing, documents, rows_of, sentence

from joblattice.llm import line_runs, near_dup, repeats
from joblattice.llm.common import Scratch, connected_classes


def runs(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def weighted(a, b):
    every = {*a, *b}
    return sum(1 / sum(max(a[d] / a[k], b[d] / b[k]) for d in every) for k in a.keys() & b.keys())


def plain(a, b):
    return len(a.keys() & b.keys()) / len({*a, *b})


def test_components(spark):
    draw = random.Random(4)
    edges = [(f"n{draw.randrange(300):03d}", f"n{draw.randrange(300):03d}") for _ in range(200)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("hub", f"leaf{i}") for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    frame = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.root for r in connected_classes(frame, Scratch(spark)).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_classes(frame.limit(0), Scratch(spark)).count() == 0


def test_signature_estimates_probability_jaccard():
    draw, own = random.Random(6), near_dup.Shingler()
    for share in (0.01, 0.03, 0.1):
        a = [f"w{draw.randrange(200)}" for _ in range(300)] * 2
        b = [w if draw.random() > share else f"v{draw.randrange(200)}" for w in a]
        owner, run, count = own([a, b])
        chosen = near_dup.signatures(owner, run, count, 2, 4096)
        x, y = runs(" ".join(a)), runs(" ".join(b))
        exact = near_dup.similarity_of((run[owner == 0], count[owner == 0]), (run[owner == 1], count[owner == 1]))
        assert np.allclose(exact, (weighted(x, y), plain(x, y)))
        assert abs((chosen[0] == chosen[1]).mean() - exact[0]) < 0.04


def near_texts():
    draw = random.Random(8)
    texts = awkward_texts()
    for group in range(12):
        base = sentence(draw, draw.choice([8, 30, 150])).split()
        for _ in range(6):
            words = [w if draw.random() > 0.02 else f"x{draw.randrange(999)}" for w in base]
            texts.append((100 + len(texts), " ".join(words)))
    for text in ("a b c d e f g h i j k l m n " * 9, "a b c d e f g h i j k l m n " * 12):
        texts.append((100 + len(texts), text))
    return texts


def test_classes_equal_brute_force(spark):
    texts = near_texts()
    found = [runs(t or "") for _, t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if found[i] and found[j] and max(weighted(found[i], found[j]), plain(found[i], found[j])) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, (doc_id, _) in enumerate(texts):
        least.setdefault(find(i), []).append(doc_id)
    expected = [(d, d if found[i] is None else min((x for x in least[find(i)] if x is not None), default=None))
                for i, (d, _) in enumerate(texts)]
    docs = clashing(documents(spark, texts), "digest", "band", "key")
    assert rows_of(near_dup.classes(docs), "doc_id", "class_id") == sorted(expected, key=repr)
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    groups = len({find(i) for i in range(len(texts)) if found[i]})
    blank = len({t for t in texts if runs(t[1] or "") is None})
    assert kept.count() == groups + blank
    assert near_dup.classes(documents(spark, [])).count() == 0
    assert near_dup.keep_first(documents(spark, [])).count() == 0


def test_large_class_in_one_bucket(spark):
    """A chain whose ends are far apart, beside a hub: no link between members is lost."""
    draw = random.Random(9)
    words, texts = sentence(draw, 200).split(), []
    for i in range(40):
        words = list(words)
        words[(7 * i) % 200] = f"y{i}"
        texts.append((i, " ".join(words)))
    assert {r.class_id for r in near_dup.classes(documents(spark, texts)).collect()} == {0}


def test_chain_longer_than_the_hubs_reach(spark):
    """One band that all texts share: hubs reach four steps each way, the rest takes the last step."""
    draw = random.Random(15)
    words, texts = sentence(draw, 200).split(), []
    for i in range(40):
        words = list(words)
        words[100 + (7 * i) % 100] = f"y{i}"
        texts.append((i, " ".join(words)))
    docs = documents(spark, texts)
    bands = {b for r in near_dup.features(docs, "doc_id", "text", 5, 1, 1).collect() for b in r.bands}
    assert len(bands) == 1
    for rounds in (1, 3):
        found = near_dup.classes(docs, bands=1, rows=1, rounds=rounds).collect()
        assert {r.class_id for r in found} == {0}


def brute_spans(texts, window):
    starts = Counter()
    contents = [(t or "").encode() for _, t in texts]
    for content in contents:
        starts.update(content[i : i + window] for i in range(len(content) - window + 1))
    for content in contents:
        mark = np.zeros(len(content) + 1, int)
        for i in range(len(content) - window + 1):
            if starts[content[i : i + window]] > 1:
                mark[i] += 1
                mark[i + window] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        yield content, gone


def repeat_texts():
    draw = random.Random(10)
    texts = awkward_texts()
    passage = sentence(draw, 150)
    for i in range(12):  # shared passages, cut and changed at many places
        own = passage[draw.randrange(300) : len(passage) - draw.randrange(300)]
        at = draw.randrange(len(own))
        texts.append((200 + i, sentence(draw, draw.randrange(40)) + own[:at] + ("#" if i % 3 else "") + own[at:] + sentence(draw, draw.randrange(40))))
    texts += [(300, "ab" * 450), (301, "ba" * 300 + "c"), (302, passage[:399]), (303, passage[1:400]), (304, "q" * 401), (305, "z" * 400)]
    return texts


def test_repeats_equal_brute_force(spark):
    texts = repeat_texts()
    expected = []
    for (doc_id, _), (content, gone) in zip(texts, brute_spans(texts, 400)):
        kept = bytes(np.frombuffer(content, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        expected.append((doc_id, len(content), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    docs = clashing(documents(spark, texts), "start", "site", "inner")
    got = rows_of(repeats.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(expected, key=repr)
    assert repeats.digests(documents(spark, [])).count() == 0


def test_repeats_keep_whole_characters(spark):
    shared = "ü" * 250
    docs = documents(spark, [(1, "aé" + shared + "é"), (2, "bé" + shared + "ê"), (3, None), (4, "short")])
    kept = {r.doc_id: r.text for r in repeats.without_repeats(docs).collect()}
    assert kept == {1: "a" + "é", 2: "b" + "ê", 3: None, 4: "short"}
    assert repeats.without_repeats(documents(spark, [])).count() == 0


class Frame:
    """Gives the function that a frame would run over its batches."""

    def mapInArrow(self, run, schema):
        return run


def test_memory_of_a_worker():
    """Two tasks of an executor share what its heap leaves of 3,000 MB, in the pipeline after three operators."""
    draw = random.Random(16)
    content = [sentence(draw, 600).encode() for _ in range(1300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300), pa.int64()), pa.array(content)], names=["key", "content"])
    assert batch.nbytes > 4 << 20  # the largest that Spark sends, see joblattice.session
    coarse = repeats.coarse_blocks(Frame(), 400)
    tracemalloc.start()
    found = sum(part.num_rows for part in coarse(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 1300 and peak < 80 << 20


def test_prefix_hashes():
    content = bytes(random.Random(11).randrange(256) for _ in range(500)) * 2
    prefixes = repeats.Prefixes(content)
    start, end = np.array([3, 503, 3]), np.array([450, 950, 451])
    one, two = prefixes.first(start, end), prefixes.second(start, end, np.zeros(3, np.int64))
    assert one[0] == one[1] != one[2] and two[0] == two[1] != two[2]


def brute_lines(texts, width):
    """Distinct rows in order; the lines that each keeps."""
    rows, seen, out = sorted(set(texts), key=lambda r: (r[0] is not None, r[0] or 0)), set(), {}
    for row in rows:
        lines = (row[1] or "").split("\n")
        gone = set()
        for i in range(len(lines) - width + 1):
            run = tuple(lines[i : i + width])
            if run in seen:
                gone.update(range(i, i + width))
            seen.add(run)
        out[row] = lines, gone
    return out


def line_texts():
    draw = random.Random(12)
    texts = [t for t in awkward_texts() if t[0] not in (None, 20)] + [(None, "no id\nhere")]
    for i in range(40):
        texts.append((400 + i, "\n".join(draw.choice("abcde") for _ in range(draw.randrange(1, 12)))))
    return texts


def test_lines_equal_brute_force(spark):
    texts = line_texts()
    docs = clashing(documents(spark, texts), "line", "gone", "name")
    for width in (1, 2, 3, 5):
        known = brute_lines(texts, width)
        expected = []
        for row in texts:
            lines, gone = known[row]
            kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            runs_ = sum(1 for i in gone if i - 1 not in gone)
            expected.append((row[0], len(lines), len(gone), runs_, hashlib.sha256(kept.encode()).hexdigest()))
        got = rows_of(line_runs.digests(docs, width), "doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256")
        assert got == sorted(expected, key=repr)
    kept = line_runs.without_runs(docs)
    assert kept.columns == docs.columns
    known = brute_lines(texts, 2)
    assert kept.count() == sum(len(known[r][1]) < len(known[r][0]) for r in texts)
    assert line_runs.digests(documents(spark, [])).count() == 0


def test_long_line_between_lines_that_differ(spark):
    draw = random.Random(13)
    long, short = sentence(draw, 20), sentence(draw, 19)
    texts = [(i, f"a{i}\n{long}\nb{i}\n{short}\nc{i}") for i in range(3)] + [(3, long)]
    kept = line_runs.without_runs(documents(spark, texts), long_words=20)
    assert rows_of(kept, "doc_id", "text") == [(0, texts[0][1])] + [(i, f"a{i}\nb{i}\n{short}\nc{i}") for i in (1, 2)]
    assert kept.count() == 3


def test_intervals_of_all_levels(spark):
    """The places of each level are those whose prefix occurs elsewhere, and its first place is the least."""
    draw = random.Random(8)
    shared = [f"s{i}" for i in range(13)]
    texts = [(i, "\n".join([f"own {i}", *shared[draw.randrange(4) : draw.randrange(6, 14)], *(draw.choice("abc") for _ in range(6))])) for i in range(30)]
    texts += [(40, "\n".join(shared * 3))]
    levels = line_runs.repeated_prefixes(documents(spark, texts), 2, "doc_id", "text", Scratch(spark))
    lines = {i: t.split("\n") for i, t in texts}
    assert [width for width, _ in levels] == [2, 4, 8, 16]
    for width, inside in levels:
        places = {}
        for i, own in lines.items():
            for at in range(len(own) - width + 1):
                places.setdefault(tuple(own[at : at + width]), []).append((i, at))
        expected = sorted((*p, *min(group)) for group in places.values() if len(group) > 1 for p in group)
        assert sorted((r["doc_id"], r["line"], r["first"]["doc_id"], r["first"]["line"]) for r in inside.collect()) == expected
