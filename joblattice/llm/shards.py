"""Two-pass external shuffle of a table into shards.

The first pass scatters the records uniformly into buckets that fit into memory, by a seeded
hash of the record's place in the table; no key, however common, decides. The second shuffles
each bucket (Spark's ``shuffle`` is a seeded Fisher-Yates shuffle) and writes it. The buckets
one after the other are a random order of the whole table, which is cut into shards of equal
numbers of rows, at most one apart.

The table must read alike each time (files do), for rows are numbered by their place.
Null ids and texts, empty texts and repeated rows are records like any other. An empty table
gives an empty table. All columns are kept; ``shard`` and ``slot`` are added, and columns that
already have these names are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAW = "rows"


def shuffle_to_shards(
    docs: DataFrame, path: str, shards: int = 24, seed: int = 7, bucket_bytes: int = 16 << 20, text_col: str = "text",
) -> DataFrame:
    """Write all rows below ``path``, one folder per shard; returns the written table.

    ``bucket_bytes`` of text at most are expected in one bucket, which one task holds.
    """
    spark = docs.sparkSession
    if taken := {"shard", "slot"} & set(docs.columns):
        raise ValueError(f"columns in use: {sorted(taken)}")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 64
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("bytes")).first()
    rows, buckets = total["n"], max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    bucket = F.pmod(place, F.lit(buckets)).cast("int")

    counts = docs.select(bucket.alias("bucket")).groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))

    record = F.struct(place.alias("place"), F.struct(*docs.columns).alias("row"))
    records = docs.select(bucket.alias("bucket"), record.alias("record"), F.lit(None).cast("long").alias("base"))
    # a bucket's offset travels with its records: texts are exchanged once
    numbers = offsets.select("bucket", F.lit(None).cast(records.schema["record"].dataType).alias("record"), "base")
    scattered = records.union(numbers).repartitionById(buckets, F.col("bucket"))
    # sorted first: what a bucket receives comes in any order, its shuffle is always the same
    drawn = scattered.groupBy("bucket").agg(
        F.sort_array(F.collect_list("record")).alias("records"), F.max("base").alias("base")).select(
        "base", F.posexplode(F.shuffle("records", F.lit(seed))).alias("at", "record"))
    numbered = drawn.withColumn("n", F.col("base") + F.col("at"))
    shard = F.expr(f"cast(n * {shards} div {max(rows, 1)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {rows} + {shards - 1}) div {shards}")
    placed = numbered.withColumn("shard", shard).select("record.row.*", "shard", (F.col("n") - first).alias("slot"))
    placed.write.mode("overwrite").partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path).select(placed.columns)
