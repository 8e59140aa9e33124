"""Staged tables and connected classes, shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.session import scratch_dir


_HELD: dict[tuple, Any] = {}


def held(make: Callable[..., Any], *options: Any) -> Any:
    """``make(*options)``, kept in this worker process as long as it runs tasks of one operator.

    A worker lives through many operators of a session. What one of them has learnt of words goes
    when another begins, so that a worker holds no more in a long pipeline than in one operator.
    """
    key = (make.__module__, make.__name__, *options)
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make(*options)
    return _HELD[key]


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the search for reference cycles, which would walk all that an encoder keeps again and again."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


class Scratch:
    """Tables written to the shared folder, so that a lost executor loses none of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/llm-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(rows.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            target = jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(conf).delete(target, True)


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def connected_classes(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, root) of every node of ``edges(a, b)``; root is the least node of its component.

    Alternates two rewrites of the edge list until it is a set of stars. Each gives a node
    its least neighbour, found by a partial aggregate, through a plain join that Spark splits
    where a node has very many edges; no neighbourhood is ever gathered. The number of rounds
    grows with the logarithm of the longest chain.
    """
    name, done, step = "edges0", False, 0
    current = scratch.table(name, edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not done:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # the edge from a node to its own least neighbour stays
        large = large.union(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).distinct()
        step += 1
        following = scratch.table(f"edges{step}", small)
        # stars: every node has one edge, and no centre has an edge of its own
        many = following.groupBy("a").count().filter("count > 1").select("a")
        chained = following.join(following.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        done = many.union(chained).isEmpty()
        scratch.drop(name)
        current, name = following, f"edges{step}"
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
