"""Costly values computed once per row.

Spark moves a filter below the projection that computes its input, or infers one from an
explode, and the moved copy computes the same value a second time. These helpers keep
that from happening where the value is costly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def once_per_row(return_type: T.DataType) -> Callable:
    """A pandas UDF that no filter is moved across."""

    def wrap(function: Callable):
        return F.pandas_udf(function, return_type).asNondeterministic()

    return wrap


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` through a one-element ``inline``, which no filter is moved across.

    It stays inside generated code; a column used several times further on is read, not
    computed again.
    """
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select("*", F.inline(F.array(values)))
