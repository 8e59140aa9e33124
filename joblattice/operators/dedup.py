"""Duplicate handling that stays even when one id owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ARRIVAL = ("seq", "pos")
ROWS_PER_SLICE = 1_000_000


def first_arrival(
    rows: DataFrame, keys: Sequence[str] = ("id",), order: Sequence[str] = ARRIVAL
) -> DataFrame:
    """Earliest row per key.

    The rank filter lets Spark keep one row per key and input task before the shuffle
    (WindowGroupLimit), so a hot key costs one row per task, not all of its copies.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def known_ids(ids: DataFrame, store: DataFrame) -> DataFrame:
    """The given ids that the store holds.

    Probing the store with the ids lets Spark broadcast a small batch of ids instead of
    shuffling the store; a large batch becomes a shuffled join of two narrow columns.
    """
    return store.select("id").join(ids.select("id"), "id", "left_semi")


def sliced(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` with a further key ``_slice``.

    A key with more than ``rows_per_slice`` rows is cut into slices by arrival, and its
    one lookup row repeated per slice, so that no task gets all rows of a key. At most
    (row count / rows_per_slice) keys can be that frequent, which bounds the broadcast
    list of slice counts. ``lookup`` holds a key at most once.
    """
    copies = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    hot = copies.filter(F.col("_copies") > rows_per_slice).select(
        *keys, F.ceil(F.col("_copies") / rows_per_slice).cast("int").alias("_slices")
    )
    slices = F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)
    repeated = lookup.join(F.broadcast(hot), [*keys], "left").withColumn("_slice", F.explode(slices))
    spread = rows.join(F.broadcast(hot), [*keys], "left").withColumn(
        "_slice",
        F.coalesce(F.pmod(F.xxhash64(*order), F.col("_slices")).cast("int"), F.lit(0)),
    )
    return spread.drop("_slices"), repeated.drop("_slices")


def drop_known(
    rows: DataFrame,
    store: DataFrame,
    order: Sequence[str] = ARRIVAL,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Rows whose id is not in the store, even where one id has very many rows."""
    known = known_ids(rows.select("id").distinct(), store)
    left, right = sliced(rows, known, ("id",), order, rows_per_slice)
    return left.join(right, ["id", "_slice"], "left_anti").drop("_slice")
