"""Listing store, run log and capture tables on a shared file system.

Every batch appends under a folder of its own, ``batch_id=<id>``, and replaces just that
folder when it is run again, so a retried batch leaves no second copy. Beside the listings
stands a table of their ids, cut into ``KEY_BUCKETS`` folders by a hash of the id: what a
batch asks about its ids is answered from the buckets they fall into. ``compact`` merges the
folders of older batches. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblattice.operators.runs import latest_run
from joblattice.schema import CAPTURE_SCHEMA, LISTING_COLUMNS, LISTING_SCHEMA, RUN_ERROR_SCHEMA, RUN_LOG_SCHEMA
from joblattice.session import delete_folder, folder_bytes, folders, make_folder, rename_folder

TABLES = {
    "listings": LISTING_SCHEMA,
    "listing_keys": T.StructType([T.StructField("id", T.StringType())]),
    "run_log": RUN_LOG_SCHEMA,
    "run_errors": RUN_ERROR_SCHEMA,
}
# Part of the stored format.
KEY_BUCKETS = 32
FILE_BYTES = 128 << 20
# Bodies are long texts; captures are written once and read once over all adapters.
CAPTURE_FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.page.size": str(4 << 20)}
_BATCH, _BUCKET = T.StructField("batch_id", T.StringType(), False), T.StructField("bucket", T.IntegerType())


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def _batch_path(root: str, table: str, batch_id: str) -> str:
    return f"{table_path(root, table)}/batch_id={batch_id}"


def batches(spark: SparkSession, root: str, table: str) -> list[str]:
    """The batches in a table, the one written last at the end."""
    names = folders(spark, table_path(root, table))
    return [name.removeprefix("batch_id=") for name in names if name.startswith("batch_id=")]


def ensure_tables(spark: SparkSession, root: str) -> None:
    """Create the tables that do not exist yet, and end a broken-off compaction.

    An empty table is an empty folder: every read states its schema.
    """
    for table in TABLES:
        make_folder(spark, table_path(root, table))
    for name in folders(spark, f"{root.rstrip('/')}/_compactions"):
        if name.startswith("open-"):
            _finish_compaction(spark, root, name.removeprefix("open-"))


def _read(spark: SparkSession, root: str, table: str) -> DataFrame:
    more = [_BUCKET, _BATCH] if table == "listing_keys" else [_BATCH]
    schema = T.StructType([*TABLES[table].fields, *more])
    return spark.read.schema(schema).parquet(table_path(root, table))


def write_batch(rows: DataFrame, root: str, table: str, batch_id: str) -> None:
    rows.select(*TABLES[table].fieldNames()).write.mode("overwrite").parquet(_batch_path(root, table, batch_id))


def key_bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def write_listings(listings: DataFrame, root: str, batch_id: str, ids: DataFrame | None = None) -> None:
    """Write a batch of listings, then the table of its ids (``ids``, or read back)."""
    spark = listings.sparkSession
    write_batch(listings, root, "listings", batch_id)
    if ids is None:
        ids = spark.read.schema(LISTING_SCHEMA).parquet(_batch_path(root, "listings", batch_id))
    _write_keys(ids.select("id"), _batch_path(root, "listing_keys", batch_id))


def _write_keys(ids: DataFrame, path: str) -> None:
    keyed = ids.withColumn("bucket", key_bucket(F.col("id"))).repartition("bucket").sortWithinPartitions("bucket", "id")
    keyed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def buckets_of(ids: DataFrame) -> list[int]:
    """The key buckets the ids fall into, ``KEY_BUCKETS`` numbers at most."""
    return sorted(r[0] for r in ids.filter("id is not null").select(key_bucket(F.col("id"))).distinct().collect())


def read_keys(spark: SparkSession, root: str, buckets: Sequence[int] | None = None, without_batch: str | None = None) -> DataFrame:
    """The stored ids of the given buckets (all by default).

    Of batches without a table of ids (written before there was one, or broken off between the
    two) the listings are read.
    """
    keys = _read(spark, root, "listing_keys")
    if buckets is not None:
        keys = keys.filter(F.col("bucket").isin(list(buckets)))
    unkeyed = sorted(set(batches(spark, root, "listings")) - set(batches(spark, root, "listing_keys")))
    stored = keys.select("id", "batch_id")
    if unkeyed:
        listed = _read(spark, root, "listings").filter(F.col("batch_id").isin(unkeyed))
        stored = stored.unionByName(listed.select("id", "batch_id"))
    if without_batch is not None:
        stored = stored.filter(F.col("batch_id") != without_batch)
    return stored.select("id")


def read_batch_keys(spark: SparkSession, root: str, batch_id: str) -> DataFrame:
    """The ids that a batch stored."""
    return _read(spark, root, "listing_keys").filter(F.col("batch_id") == batch_id).select("id")


def read_listings(spark: SparkSession, root: str, without_batch: str | None = None) -> DataFrame:
    """All stored listings; ``without_batch`` leaves out what a retried batch wrote before."""
    stored = _read(spark, root, "listings")
    if without_batch is not None:
        stored = stored.filter(F.col("batch_id") != without_batch)
    return stored.select(*LISTING_COLUMNS)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The run log, one row per run and source."""
    return latest_run(_read(spark, root, "run_log"), ("run_id", "source")).drop("batch_id")


def read_run_errors(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "run_errors").drop("batch_id")


def merged_batches(spark: SparkSession, root: str) -> set[str]:
    """Batches that compaction has merged; they can't be replaced any more."""
    path = f"{root.rstrip('/')}/_compactions"
    done = [name for name in folders(spark, path)]
    if not done:
        return set()
    rows = spark.read.schema("batch_id string").parquet(*(f"{path}/{name}" for name in done)).distinct()
    return {r[0] for r in rows.toLocalIterator()}


def compact(spark: SparkSession, root: str, keep: int = 10, file_bytes: int = FILE_BYTES) -> int:
    """Merge the folders of all batches but the last ``keep`` of each table; returns how many went.

    The merged rows are written beside the table, then named in a list of what they replace, then
    moved in; the next call of ``ensure_tables`` ends a compaction that was broken off after the
    list. Until the old folders are deleted a reader may see rows twice, so readers that count
    should not run meanwhile. A merged batch can't be tried again, so ``keep`` must cover those
    that may be.
    """
    ensure_tables(spark, root)
    recent = batches(spark, root, "run_log")[-keep:] if keep else []
    old = {table: [b for b in batches(spark, root, table) if b not in recent] for table in TABLES}
    every = sorted({b for names in old.values() for b in names})
    if max(map(len, old.values())) < 2:
        return 0
    name = uuid.uuid4().hex
    unkeyed = [b for b in old["listings"] if b not in batches(spark, root, "listing_keys")]
    for table, names in old.items():
        target = f"{table_path(root, table)}/_merged-{name}"
        rows = _read(spark, root, table).filter(F.col("batch_id").isin(names))
        if table == "listing_keys":
            listed = _read(spark, root, "listings").filter(F.col("batch_id").isin(unkeyed))
            _write_keys(rows.select("id").unionByName(listed.select("id")), target)
        else:
            size = sum(folder_bytes(spark, _batch_path(root, table, b)) for b in names)
            rows.select(*TABLES[table].fieldNames()).coalesce(max(1, -(-size // file_bytes))).write.parquet(target)
    listed = spark.createDataFrame([(b,) for b in every], "batch_id string")
    listed.coalesce(1).write.parquet(f"{root.rstrip('/')}/_compactions/open-{name}")
    _finish_compaction(spark, root, name)
    return len(every)


def _finish_compaction(spark: SparkSession, root: str, name: str) -> None:
    listed = f"{root.rstrip('/')}/_compactions/open-{name}"
    if "_SUCCESS" not in folders(spark, listed, files=True):
        delete_folder(spark, listed)
        for table in TABLES:
            delete_folder(spark, f"{table_path(root, table)}/_merged-{name}")
        return
    old = {r[0] for r in spark.read.schema("batch_id string").parquet(listed).collect()}
    for table in TABLES:
        rename_folder(spark, f"{table_path(root, table)}/_merged-{name}", _batch_path(root, table, f"merged-{name}"))
        for batch_id in old.intersection(batches(spark, root, table)):
            delete_folder(spark, _batch_path(root, table, batch_id))
    rename_folder(spark, listed, f"{root.rstrip('/')}/_compactions/{name}")


def write_captures(captures: DataFrame, path: str, gather: bool = True) -> None:
    """Append captured responses in folders by source and kind, which the adapters filter on.

    A folder gets at most 64 files. With ``gather`` off no body is shuffled, and each task writes a
    file for every folder it has rows of: for captures that come source by source.
    """
    if gather:
        captures = captures.repartition("source", "kind", F.pmod(F.xxhash64("seq", "url"), F.lit(64)))
    captures.write.mode("append").options(**CAPTURE_FILES).partitionBy("source", "kind").parquet(path)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CAPTURE_SCHEMA).parquet(path).select(*CAPTURE_SCHEMA.fieldNames())


def read_captures_stream(
    spark: SparkSession, path: str, max_files: int = 1000, schema: T.StructType = CAPTURE_SCHEMA
) -> DataFrame:
    """Captured files as they arrive, at most ``max_files`` per micro-batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return stream.select(*schema.fieldNames())
