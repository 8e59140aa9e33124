"""Repair of the structure of conversations by Hirschberg's divide and conquer.

A repaired conversation's role initials are ``(s?(ua)+)?``: read from the left they are in one of
four states (nothing, system, user, assistant). Edits of the rows in order: Keep costs 0, Rerole to
user or assistant 3, Delete 4 (required for blank rows and duplicates), Insert of an empty user or
assistant turn 3; a truncated row that isn't deleted adds 3. Inserts belong to the row after them, so
the edits of a row are one of few codes (``K``, ``ID``, ``IIR`` ...), none the beginning of another.

The cheapest edits are found in space linear in the conversation: the costs of the four states from
the left and from the right meet at its middle, the best crossing is chosen, and both halves are
solved alike. Among equal crossings the one with the audit-least left half is taken: the forward
vector carries, beside the costs, the order of the states' least audits, which is enough to compare
them in the next row too.

Per conversation a task holds one byte a row. Texts pass by in order while the edits are applied, an
audit coming ahead of its rows; they are never gathered. Equal rows of a turn are counted before they
are exchanged, and a text's first place in its conversation is an aggregate and a join, which Spark
splits. A digest over a conversation's text is sequential, so its rows do pass through one task.

Rows are ordered by turn, null first, then role, then the digest of the text; equal rows are adjacent.
Null roles and texts are one space. Null conv_ids are one conversation. A role without or with
another initial than s, u, a can't be kept. A conversation without rows left has an empty audit. An
empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import Scratch

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # of an inserted or reroled turn
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = {"su", "ua", "au"}
INITIALS = "sua"
FAR = float("inf")
BLANKS = " \t\n\x0b\f\r"


def row_class(initial: str, doomed: bool, cut: bool) -> int:
    """What the edits of a row depend on: its role's initial, whether it has to go, whether it is cut."""
    known = INITIALS.find(initial) + 1 if initial else 0
    return 8 if doomed else known + 4 * cut


def edits_of(kind: int) -> list[list[tuple[int, int, str]]]:
    """For each state the (following state, cost, code) of the row's edits, the best for each pair."""
    initial, cut, doomed = "-sua"[kind % 4], CUT * (4 <= kind < 8), kind == 8
    out = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        at = state
        for inserts in range(3):
            cost, code = INSERT * inserts, "I" * inserts
            found = [(at, cost + DELETE, code + "D")]
            if not doomed:
                found.append((NEXT[at], cost + REROLE + cut, code + "R"))
                if (initial, at) in KEPT:
                    found.append((KEPT[initial, at], cost + KEEP + cut, code + "K"))
            for to, *rest in found:
                best[to] = min(best.get(to, (FAR, "")), tuple(rest))
            at = NEXT[at]
        out.append([(to, cost, code) for to, (cost, code) in best.items()])
    return out


EDITS = [edits_of(kind) for kind in range(9)]
# what is inserted behind the last row
ENDINGS = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def forward(rows: bytes, start: int, end: int, state: int) -> tuple[list[float], list[int]]:
    """Costs of the four states after the rows, and the order of their least audits."""
    costs, ranks = [FAR] * 4, [0] * 4
    costs[state] = 0
    for at in range(start, end):
        edits = EDITS[rows[at]]
        best: list[tuple | None] = [None] * 4
        for s in range(4):
            if costs[s] < FAR:
                for to, cost, code in edits[s]:
                    found = (costs[s] + cost, ranks[s], code)
                    if best[to] is None or found < best[to]:
                        best[to] = found
        costs = [FAR if b is None else b[0] for b in best]
        order = sorted((b[1:], s) for s, b in enumerate(best) if b is not None)
        ranks = [0] * 4
        for rank, (_, s) in enumerate(order):
            ranks[s] = rank
    return costs, ranks


def backward(rows: bytes, start: int, end: int, state: int) -> list[float]:
    """Costs from each of the four states before the rows to ``state`` after them."""
    costs = [FAR] * 4
    costs[state] = 0
    for at in range(end - 1, start - 1, -1):
        costs = [min(cost + costs[to] for to, cost, _ in edits) for edits in EDITS[rows[at]]]
    return costs


def crossing(costs: list[float], ranks: list[int], rest: list[float]) -> tuple[float, int]:
    total, _, state = min((costs[s] + rest[s], ranks[s], s) for s in range(4))
    return total, state


def solve(rows: bytes, start: int, end: int, state: int, final: int) -> Iterator[str]:
    """The codes of the audit-least cheapest edits from one state to another."""
    if end - start == 1:
        yield next(code for to, _, code in EDITS[rows[start]][state] if to == final)
    elif end > start:
        middle = (start + end) // 2
        _, meeting = crossing(*forward(rows, start, middle, state), backward(rows, middle, end, final))
        yield from solve(rows, start, middle, state, meeting)
        yield from solve(rows, middle, end, meeting, final)


def cheapest(rows: bytes) -> tuple[int, str]:
    """(cost, audit) of the rows' classes."""
    cost, final = crossing(*forward(rows, 0, len(rows), NOTHING), [ENDINGS[s][0] for s in range(4)])
    return int(cost), "".join(solve(rows, 0, len(rows), NOTHING, final)) + ENDINGS[final][1]


class Progress:
    """The edits of one audit, applied turn by turn."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield NAMES[self.state], ""

    def turns(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = KEPT[role[0], self.state]
            yield role, text
        elif edit == "R":
            self.state = NEXT[self.state]
            yield NAMES[self.state], text

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


REPORT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string")]
REPORT_DDL = ", ".join(f"{n} {t}" for n, t in REPORT)
TYPES = {"long": pa.int64(), "string": pa.string()}


class Report:
    """The counts and row classes of one conversation, row by row in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows = conv_id, bytearray()
        self.low = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def add(self, turn, role, blank, cut, again, copies):
        if not copies:  # says only that the conversation exists
            return
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.turn = turn
        initial = role[:1]
        self.illegal += (self.initial is not None and self.initial + initial not in LEGAL) + copies - 1
        self.initial = initial
        first = not (blank or again)
        self.blank += copies * blank
        self.duplicate += 0 if blank else copies - first
        self.truncated += first and cut
        self.rows.append(row_class(initial, not first, cut))
        self.rows.extend(bytes([row_class(initial, True, cut)]) * (copies - 1))

    def values(self) -> tuple:
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest(bytes(self.rows)))


def _reports(batches):
    def batch_of(found):
        columns = zip(*found)
        types = [pa.int64(), *(TYPES[t] for _, t in REPORT)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", *(n for n, _ in REPORT)])

    report = None
    for batch in batches:
        done = []
        for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "blank", "cut", "again", "copies"))):
            if report is None or conv_id != report.conv_id:
                if report is not None:
                    done.append(report.values())
                report = Report(conv_id)
            report.add(*row)
        if done:
            yield batch_of(done)
    if report is not None:
        yield batch_of([report.values()])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with a fault in rows chosen by crc32 of ``conv_id:turn``.

    ``copies`` is how often the row stands; a dropped row is there with 0.
    """
    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                said("role").alias("role"), said("text").alias("text"), fault.alias("fault"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"))


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of
    ``rows(conv_id, turn, role, text, copies)``."""
    narrow = Scratch(rows.sparkSession).table("rows", rows.select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"),
        (F.length(F.translate("text", BLANKS, "")) == 0).cast("int").alias("blank"),
        (~F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")).cast("int").alias("cut"), "copies",
    ).groupBy("conv_id", "turn", "role", "digest").agg(
        F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.sum("copies").alias("copies")).withColumn("same", F.md5(F.concat(
            F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), "digest", F.lit(":"), "role"))))
    firsts = narrow.filter("copies > 0").groupBy("same").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull().cast("int")).alias("none"))
    again = F.col("turn").isNotNull() & ((F.col("none") == 1) | (F.col("turn") > F.col("first")))
    marked = narrow.join(firsts, "same", "left").select(
        "conv_id", "turn", "role", "digest", F.col("blank").cast("boolean").alias("blank"), F.col("cut").cast("boolean").alias("cut"),
        F.coalesce(again, F.lit(False)).alias("again"), "copies")
    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return ordered.mapInArrow(_reports, f"conv_id long, {REPORT_DDL}")


def _with_texts(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports and rows, each report ahead of its conversation's rows in one task."""
    report = F.struct(*(F.col(n) for n, _ in REPORT))
    heads = reports.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                           F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), report.alias("report"))
    texts = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies",
                                             F.lit(None).cast(heads.schema["report"].dataType).alias("report"))
    both = heads.union(texts).withColumn("digest", F.md5("text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")


def _records(batch):
    names = ("conv_id", "kind", "role", "text", "copies", "report")
    for start in range(0, batch.num_rows, 256):
        part = batch.slice(start, 256)
        yield zip(*(part.column(c).to_pylist() for c in names))


def _turns(batches):
    """Repaired turns, in order."""
    head, edits, place = None, None, 0
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    for batch in batches:
        for records in _records(batch):
            out = []

            def put(turns):
                nonlocal place
                for turn in turns:
                    out.append((head, place, *turn))
                    place += 1

            for conv_id, kind, role, text, copies, report in records:
                if kind == 0:
                    if edits:
                        put(edits.rest())
                    head, edits, place = conv_id, Progress(report["audit"]), 0
                for _ in range(copies):
                    put(edits.turns(role, text))
            if out:
                yield batch_of(out)
    if edits and (last := [(head, place + i, *turn) for i, turn in enumerate(edits.rest())]):
        yield batch_of(last)


def _digested(batches):
    """Reports with the digest of the repaired conversation."""
    names = ["conv_id", *(n for n, _ in REPORT), "repaired_sha256"]
    types = [pa.int64(), *(TYPES[t] for _, t in REPORT), pa.string()]
    head, edits, digest, empty = None, None, None, True

    def put(turns):
        nonlocal empty
        for role, text in turns:
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False

    def ended():
        put(edits.rest())
        return (*head, digest.hexdigest())

    for batch in batches:
        done = []
        for records in _records(batch):
            for conv_id, kind, role, text, copies, report in records:
                if kind == 0:
                    if edits:
                        done.append(ended())
                    head, edits, digest, empty = (conv_id, *report.values()), Progress(report["audit"]), hashlib.sha256(), True
                for _ in range(copies):
                    put(edits.turns(role, text))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
    if edits:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(ended(), types)], names=names)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of the repaired conversations, places from 0."""
    reports = Scratch(rows.sparkSession).table("reports", audits(rows))
    return _with_texts(rows, reports).mapInArrow(_turns, "conv_id long, place long, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """The report of each conversation and the SHA-256 of its repaired ``role:text`` lines."""
    reports = Scratch(rows.sparkSession).table("reports", audits(rows))
    return _with_texts(rows, reports).mapInArrow(_digested, f"conv_id long, {REPORT_DDL}, repaired_sha256 string")
