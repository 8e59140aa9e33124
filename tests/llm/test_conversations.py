"""Trie and repair of conversations against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from helpers import rows_of
from pyspark.sql import types as T

from joblattice.llm import turn_repair, turn_trie

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(seed=5, convs=260, texts=4):
    """Few texts, so that prefixes are shared; nulls, gaps, copies, long ones, absent heads."""
    draw = random.Random(seed)
    said = ["Hello there.", "And then", "", None, "  \n", "é 日本!", "Why? Because.", "no end,"]
    rows = []
    for conv in draw.sample(range(1, 1000), convs) + [100, 205, -3, -100, 2**40]:
        turns = draw.choice([1, 2, 3, 5, 6, 7, 9]) if draw.random() < 0.97 else 120
        numbers = [draw.choice([i, i, i, i, None]) if draw.random() < 0.1 else i + (draw.random() < 0.1) * 3 for i in range(turns)]
        for i, turn in enumerate(numbers):
            role = draw.choice(["system", "user", "assistant", "tool", None, ""]) if draw.random() < 0.2 else ["user", "assistant"][i % 2]
            rows.append((conv, turn, role, draw.choice(said[:texts] if draw.random() < 0.7 else said)))
    rows += [(700, 1, "user", "Same.")] * 5 + [(None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(c, i, "user", "the one prefix.") for c in range(1100, 1180) for i in range(draw.choice([2, 30, 40]))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, TURNS).repartition(3)


def brute_trie(paths):
    """paths: id -> list of (role, text)."""
    members = {}
    for conv, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = sorted(c for c in convs if len(paths[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves),
                    saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def turn_order(row):
    role, text = row[2] or "", row[3] or ""
    return (row[1] is not None, row[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def brute_rebuilt(rows):
    own = {}
    for row in sorted((r for r in rows if r[0] is not None), key=turn_order):
        own.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("chunk", [1, 3, 20_000])
def test_trie_equals_brute_force(spark, monkeypatch, chunk):
    rows = [r for r in conversations(convs=60) if r[1] is None or r[1] < 20]
    # the chunk of the tasks; a worker imports the module anew, so it is passed in the closure
    monkeypatch.setattr(turn_trie, "_tries", tries_of(chunk))
    found = turn_trie.nodes(turn_trie.rebuilt(frame(spark, rows).selectExpr("*", "'x' as key", "1 as run", "2 as depth")))
    assert rows_of(found, *NODE) == brute_trie(brute_rebuilt(rows))


def tries_of(chunk):
    def run(batches):
        turn_trie.CHUNK = chunk
        yield from turn_trie._tries(batches)

    return run


def test_long_and_empty_conversations(spark):
    assert turn_trie.nodes(turn_trie.rebuilt(frame(spark, []))).count() == 0
    rows = [(c, i, "user", f"t{min(i, 390)}") for c in (101, 102, 100, 103) for i in range(400 + c % 100)]
    assert rows_of(turn_trie.nodes(turn_trie.rebuilt(frame(spark, rows))), *NODE) == brute_trie(brute_rebuilt(rows))


def test_radix_nodes_grow_and_split():
    draw = random.Random(1)
    keys = sorted({bytes(draw.randrange(256) for _ in range(2)) + bytes(14) for _ in range(3000)})
    root = turn_trie.radix_tree(keys)
    kinds, found, stack = set(), [], [root]
    while stack:
        node = stack.pop()
        kinds.add(node.slots)
        assert node.slots >= sum(1 for _ in node.below())
        found += [node.row] * (node.row >= 0)
        stack.extend(child for _, child in node.below())
        for byte, child in node.below():
            assert node.child(byte) is child
    assert sorted(found) == list(range(len(keys))) and {4, 16, 256} <= kinds
    small = turn_trie.Node(b"")
    for count, slots in ((4, 4), (5, 16), (16, 16), (17, 48), (48, 48), (49, 256), (256, 256)):
        while sum(1 for _ in small.below()) < count:
            byte = next(b for b in (draw.randrange(256) for _ in itertools.count()) if small.child(b) is None)
            small.add(byte, turn_trie.Node(bytes([byte])))
        assert small.slots == slots and all(child.path == bytes([b]) for b, child in small.below())
    assert small.child(7).path == b"\x07"


# --- repair


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        said = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        fault = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = "user" if fault == 4 else said[2], "" if fault == 1 else re.sub("[.!?]", "", said[3]) if fault == 2 else said[3]
        out.setdefault(conv, [])
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows, faults):
    """Least (cost, audit, turns) by the table of all suffixes, with the strings themselves."""
    grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {(len(rows), s): min((3 * k, "I" * k, t) for k, t in ends) for s, ends in {
        "": [(0, ())], "s": [(2, (("user", ""), ("assistant", "")))], "u": [(1, (("assistant", ""),))], "a": [(0, ())]}.items()}
    for i in range(len(rows) - 1, -1, -1):
        _, role, text = rows[i]
        plain = {}
        for s in grammar:
            found = []
            cost, audit, turns = best[i + 1, s]
            found.append((cost + 4, "D" + audit, turns))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] in grammar[s]:
                    cost, audit, turns = best[i + 1, grammar[s][role[:1]]]
                    found.append((cost + more, "K" + audit, ((role, text), *turns)))
                for name in ("user", "assistant"):
                    if name[0] in grammar[s]:
                        cost, audit, turns = best[i + 1, name[0]]
                        found.append((cost + 3 + more, "R" + audit, ((name, text), *turns)))
            plain[s] = min(found)
        for _ in range(4):  # inserts before the row
            for s in grammar:
                for name in ("user", "assistant"):
                    if name[0] in grammar[s]:
                        cost, audit, turns = plain[name[0]]
                        plain[s] = min(plain[s], (cost + 3, "I" + audit, ((name, ""), *turns)))
        best.update({(i, s): v for s, v in plain.items()})
    return best[0, ""]


def brute_report(conv, rows):
    faults = faults_of(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, kept = brute_repair(rows, faults)
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            sha("\n".join(f"{r}:{t}" for r, t in kept))), kept


def test_repair_equals_brute_force(spark):
    rows = conversations()
    expected = {c: brute_report(c, r) for c, r in brute_damage(rows).items()}
    damaged = turn_repair.damaged(frame(spark, rows).selectExpr("*", "'x' as copies", "1 as digest", "2 as report"))
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert rows_of(turn_repair.digests(damaged), *columns) == sorted((e for e, _ in expected.values()), key=repr)
    turns = {}
    for conv, _, role, text in rows_of(turn_repair.repaired(damaged).orderBy("conv_id", "place"), "conv_id", "place", "role", "text"):
        turns.setdefault(conv, 0)
        turns[conv] += 1
    assert turns == {c: len(kept) for c, (_, kept) in expected.items() if kept}
    initials = {}
    for r in turn_repair.repaired(damaged).collect():
        initials.setdefault(r["conv_id"], {})[r["place"]] = r["role"][0]
    assert all(re.fullmatch("s?(ua)+", "".join(v[i] for i in range(len(v)))) for v in initials.values())


def test_all_short_conversations_have_the_least_audit():
    """Every sequence of classes up to four rows, against the table of suffixes."""
    names = {"-": "tool", "s": "system", "u": "user", "a": "assistant"}
    kinds = [(i, f) for i in "-sua" for f in ("", "truncated")] + [("u", "blank")]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            classes = bytes(turn_repair.row_class(i, f == "blank", f == "truncated") for i, f in rows)
            cost, audit, _ = brute_repair([(0, names[i], "x") for i, _ in rows], [f for _, f in rows])
            assert turn_repair.cheapest(classes) == (cost, audit)


def test_long_conversation_in_linear_space():
    draw = random.Random(2)
    rows = [(draw.choice("-sua"), draw.choice(["", "", "truncated", "blank"])) for _ in range(2000)]
    names = {"-": "tool", "s": "system", "u": "user", "a": "assistant"}
    classes = bytes(turn_repair.row_class(i, f == "blank", f == "truncated") for i, f in rows)
    assert turn_repair.cheapest(classes) == brute_repair([(0, names[i], "x") for i, _ in rows], [f for _, f in rows])[:2]


def test_empty_conversations(spark):
    assert turn_repair.digests(turn_repair.damaged(frame(spark, []))).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = turn_repair.digests(turn_repair.damaged(frame(spark, [(dropped, 0, "user", "Gone.")]))).collect()
    assert [tuple(r) for r in found] == [(dropped, 0, 0, 0, 0, 0, 0, "", sha(""))]
