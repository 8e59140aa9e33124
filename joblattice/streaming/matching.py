"""Pages of a capture stream and the search records that led to them, matched as keyed state.

Per (source, url) the state holds the first search record, or the pages that came before it. A
micro-batch touches the keys it holds rows of and no others. A page leaves as soon as its record
is there; a page that has waited ``wait`` leaves without one, and a record is forgotten when for
``wait`` neither it nor a page of it has come. The clock is the start of a row's micro-batch, which
Spark logs with it, so a replayed micro-batch sees the same time; no row is late unless the driver's
clock runs back by more than ``clock_skew``.

The state holds what a page says (title, texts), never its body.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from joblattice.plans.adapters import FIELDS, found_rows

WAIT = timedelta(days=7)
CLOCK_SKEW = timedelta(minutes=10)
# The fixed provider that keeps state with timers and lists.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def _strings(names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


PAGE = ["ld_title", "ld_company", "ld_description", "ld_location", "ld_date", "text", "page_title"]
RECORD = ["title", "company", "location", "posted_at", "description"]
_SEQ, _AT = T.StructField("seq", T.LongType()), T.StructField("at_ms", T.LongType())
WAITING_STATE = T.StructType([_AT, _SEQ, *_strings(PAGE)])
RECORD_STATE = T.StructType([_AT, _SEQ, T.StructField("pos", T.IntegerType()), *_strings(RECORD)])
MATCHED = T.StructType([
    T.StructField("part", T.StringType()), *_strings(["source", "url"]), _SEQ, *_strings(PAGE),
    *_strings([f"found_{name}" for name in RECORD]), T.StructField("fetched", T.IntegerType()),
])


def _order(record: Any) -> tuple:
    """Arrival; a missing number comes first, as in a sort."""
    return tuple((value is not None, value or 0) for value in (record.seq, record.pos))


class RecordMatcher(StatefulProcessor):
    def __init__(self, wait: timedelta):
        self.wait_ms = int(wait.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD_STATE)
        self.waiting = handle.getListState("waiting", WAITING_STATE)

    def _page(self, key: tuple, page: Any, record: Any) -> Row:
        found = [None] * len(RECORD) if record is None else [getattr(record, name) for name in RECORD]
        return Row(*MATCHED.fieldNames())("page", *key, page.seq, *(getattr(page, name) for name in PAGE), *found, 0)

    def _kept(self, record: Any, at_ms: int) -> Any:
        """The record with a new time to forget it."""
        row = Row(*RECORD_STATE.fieldNames())(at_ms, record.seq, record.pos, *(getattr(record, name) for name in RECORD))
        self.record.update(row)
        self.handle.registerTimer(at_ms + self.wait_ms)
        return row

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        record = _named(self.record.get(), RECORD_STATE) if self.record.exists() else None
        early, known, fetched, at_ms, first = [], record is not None, 0, 0, record
        for row in rows:
            at_ms = row.at_ms
            if row.part == "found":
                fetched += row.fetched
                first = row if first is None or _order(row) < _order(first) else first
            else:
                early.append(row)
        if fetched:
            empty = [None] * (len(PAGE) + len(RECORD))
            yield Row(*MATCHED.fieldNames())("found", *key, None, *empty, fetched)
        if first is not None:
            record = self._kept(first, at_ms)
            if not known:
                for page in self.waiting.get():
                    yield self._page(key, _named(page, WAITING_STATE), record)
                self.waiting.clear()
            for page in early:
                yield self._page(key, page, record)
        elif early:
            made = Row(*WAITING_STATE.fieldNames())
            self.waiting.appendList([made(at_ms, p.seq, *(getattr(p, name) for name in PAGE)) for p in early])
            self.handle.registerTimer(at_ms + self.wait_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.record.exists() and _named(self.record.get(), RECORD_STATE).at_ms + self.wait_ms <= now:
            self.record.clear()
        waiting = [_named(page, WAITING_STATE) for page in self.waiting.get()]
        left = [page for page in waiting if page.at_ms + self.wait_ms > now]
        if len(left) < len(waiting):
            self.waiting.clear()
            if left:
                self.waiting.appendList(left)
        for page in waiting:
            if page.at_ms + self.wait_ms <= now:
                yield self._page(key, page, None)


def _named(values: Any, schema: T.StructType) -> Row:
    """A stored value as a row with names."""
    return Row(*schema.fieldNames())(*values)


def matched(captures: DataFrame, role: str, sources: list[str], wait: timedelta = WAIT, clock_skew: timedelta = CLOCK_SKEW) -> DataFrame:
    """The pages of a capture stream with their search records (``part`` is page) and the results
    counted as fetched (found), as rows of ``MATCHED``."""
    columns = [F.col(name) for name in MATCHED.fieldNames() if not name.startswith("found_")]
    rows = found_rows(captures, role, sources).withColumn("part", F.lit("found"))
    for source in sources:
        rows = rows.unionByName(FIELDS[source](captures).withColumn("part", F.lit("page")), allowMissingColumns=True)
    for name in PAGE:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    # without an address nothing can meet
    alone = rows.filter("url is null").select(
        *columns[:-1], *(F.lit(None).cast("string").alias(f"found_{name}") for name in RECORD), F.coalesce("fetched", F.lit(0)).alias("fetched"))
    timed = rows.filter("url is not null").withColumn("at", F.current_timestamp()).withWatermark(
        "at", f"{int(clock_skew.total_seconds() * 1000)} milliseconds").withColumn("at_ms", F.unix_millis("at"))
    met = timed.groupBy("source", "url").transformWithState(
        statefulProcessor=RecordMatcher(wait), outputStructType=MATCHED, outputMode="Append", timeMode="EventTime")
    return met.unionByName(alone)
