"""Removal of later copies of repeated runs of lines.

A text is its sequence of lines (cut at line feeds). The suffixes of all sequences are ranked by
prefix doubling across rows: the name of the 2w lines from a place is made of the names of the w lines
from there and of the w lines after them, which a join brings together. A name stands for a rank: equal
names are an interval of the suffix array with a common prefix of w lines, and the sorted order within
the array, which nothing depends on, is not made. Names are two hashes of 64 bits. Only places in an
interval of two or more go on, since a longer prefix repeats only where both its parts do; doubling ends
when no prefix repeats, after as many rounds as the logarithm of the longest repeated run.

Of each interval of ``min_lines`` or more the first place stays, in order of id, then of row hash, then
of line; null ids come first. At every later place the interval's lines are deleted; what overlaps or
touches is one maximal run. An interval's first place is a partial aggregate, and its places meet it
in a plain join, which Spark splits: a line that a third of all rows hold gathers nowhere.

Everything runs as DataFrame expressions. Null and empty texts are one empty line. Repeated rows
(same id and text) are one document and are treated alike. Texts with fewer lines than
``min_lines`` stay whole. With ``long_words``, a single line of at least so many words (cut at
white space) is a run as well, in texts of any number of lines. Extra columns are ignored by ``digests`` and kept by ``without_runs``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import Scratch, text_or_empty


def lines_of(text_col: str) -> Column:
    return F.split(text_or_empty(text_col), "\n", -1)


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def line_names(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, line, a, b): the name of every line, two hashes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), lines_of(text_col).alias("lines"))
    lines = rows.select("doc_id", "key", F.posexplode("lines").alias("line", "words"))
    return lines.select("doc_id", "key", "line", F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), "words").alias("b"))


def in_intervals(names: DataFrame) -> DataFrame:
    """The places of ``names`` whose prefix occurs at another place, with the first of its interval's places."""
    place = F.struct("doc_id", "key", "line")
    intervals = names.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    return names.join(intervals.drop("n"), ["a", "b"]).select("doc_id", "key", "line", "a", "b", "first")


def doubled(inside: DataFrame, apart: int) -> DataFrame:
    """Names of the prefixes made of one from a place and one ``apart`` lines on.

    A longer prefix that repeats has both parts in intervals, so the other places are left out.
    """
    later = inside.select("key", (F.col("line") - apart).alias("line"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    joined = inside.join(later.dropDuplicates(["key", "line"]), ["key", "line"])  # repeated rows are one document
    return joined.select("doc_id", "key", "line", F.xxhash64("a", "a2").alias("a"), F.xxhash64("b2", "b").alias("b"))


def repeated_prefixes(docs: DataFrame, min_lines: int, id_col: str, text_col: str, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """For each prefix length that doubling gives, from ``min_lines`` on, the places in intervals of it."""
    width, found = 1, []
    inside = scratch.table("inside1", in_intervals(scratch.table("names1", line_names(docs, id_col, text_col))))
    scratch.drop("names1")
    while not inside.isEmpty():
        if width >= min_lines:
            found.append((width, inside))
        apart = min(width, min_lines - width) if width < min_lines else width
        names = scratch.table(f"names{width + apart}", doubled(inside, apart))
        width += apart
        inside = scratch.table(f"inside{width}", in_intervals(names))
    return found


def long_lines(docs: DataFrame, long_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, line, name) of every line of at least ``long_words`` words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), lines_of(text_col).alias("lines"))
    lines = rows.select("doc_id", "key", F.posexplode("lines").alias("line", "words"))
    lines = lines.filter(F.size(F.regexp_extract_all("words", F.lit(r"(\S+)"), 1)) >= long_words)
    return lines.select("doc_id", "key", "line", F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), "words").alias("b"))


def merged_spans(spans: Column) -> Column:
    """Sorted spans (start, end) joined where they overlap or touch: the maximal runs."""
    def add(runs: Column, span: Column) -> Column:
        last = F.element_at(runs, -1)
        grown = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))))
        fresh = F.concat(runs, F.array(F.struct(span["start"].alias("start"), span["end"].alias("end"))))
        return F.when((F.size(runs) > 0) & (span["start"] <= last["end"]), grown).otherwise(fresh)

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def deleted_lines(docs: DataFrame, min_lines: int, id_col: str, text_col: str, long_words: int | None = None) -> DataFrame:
    """(key, gone): the deleted lines of each row that has any."""
    scratch = Scratch(docs.sparkSession)
    found = repeated_prefixes(docs, min_lines, id_col, text_col, scratch)
    if long_words is not None and min_lines > 1:
        found.append((1, in_intervals(scratch.table("long", long_lines(docs, long_words, id_col, text_col)))))
    place = F.struct("doc_id", "key", "line")
    spans = [inside.filter(place > F.col("first")).select(
        "key", F.struct(F.col("line").alias("start"), (F.col("line") + width).alias("end")).alias("span")) for width, inside in found]
    none = docs.select(row_key(id_col, text_col).alias("key"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")).alias("span")).filter("false")
    runs = reduce(DataFrame.union, spans, none).groupBy("key").agg(merged_spans(F.sort_array(F.collect_set("span"))).alias("runs"))
    lines = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["end"] - 1)))
    return scratch.table("gone", runs.select("key", lines.alias("gone")))


def _kept(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with columns __lines, __gone and __kept (line numbers)."""
    found = gone.select(F.col("key").alias("__key"), F.col("gone").alias("__gone"))
    # texts are exchanged at every size, so small tables show the plan of large ones
    rows = docs.withColumn("__key", row_key(id_col, text_col)).join(found.hint("merge"), "__key", "left").drop("__key")
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    return rows.withColumn("__lines", lines_of(text_col)).withColumn(
        "__kept", F.when(F.col("__gone").isNotNull(), F.array_except(every, F.col("__gone"))))


def kept_text(text_col: str) -> Column:
    lines = F.transform("__kept", lambda i: F.get("__lines", i))
    return F.when(F.col("__kept").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))


def digests(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, kept_sha256) of each row."""
    columns = docs.select(F.col(id_col), F.col(text_col))
    rows = _kept(columns, deleted_lines(columns, min_lines, id_col, text_col), id_col, text_col)
    removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone"))
    starts = F.array_except("__gone", F.transform("__gone", lambda i: i + 1))
    return rows.select(
        F.col(id_col).cast("long").alias("doc_id"), F.size("__lines").alias("n_lines"), removed.alias("n_removed"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size(starts)).alias("n_runs"),
        F.sha2(F.coalesce(kept_text(text_col), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def without_runs(
    docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None,
) -> DataFrame:
    """The documents without the deleted lines; a document of deleted lines only goes."""
    rows = _kept(docs, deleted_lines(docs, min_lines, id_col, text_col, long_words), id_col, text_col)
    rows = rows.filter(F.col("__kept").isNull() | (F.size("__kept") > 0))
    return rows.withColumn(text_col, kept_text(text_col)).select(docs.columns)
