"""The table of ids, and the merging of batches."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from joblattice.plans.ingest import default_embedder, ingest_batch, insert_if_absent
from joblattice.sources import store as tables
from joblattice.operators.validate import with_identity

RAW = "title string, company string, url string, description string, location string, source string, seq long, fetched int"
OPTIONS = {"embedder": default_embedder(8), "min_confidence": 0.0}


def raw(spark, *urls):
    return spark.createDataFrame([("T", "C", u, f"text {u}", "here", "s", i, 1) for i, u in enumerate(urls)], RAW)


def listings(spark, *urls):
    rows = with_identity(raw(spark, *urls)).withColumns({
        "posted_at": F.lit(None).cast("string"), "skills": F.array(F.lit("x")), "confidence": F.lit(0.9),
        "embedding": F.lit(None).cast("array<float>"), "ingested_at": F.current_timestamp()})
    return rows.select(*tables.LISTING_COLUMNS)


def data_files(root, table):
    return [f for _, _, names in os.walk(f"{root}/{table}") for f in names if f.endswith(".parquet")]


def urls(spark, root):
    return sorted(r["url"] for r in tables.read_listings(spark, root).collect())


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "store")
    many = [f"u{i}" for i in range(300)]
    insert_if_absent(listings(spark, *many), root, "b1")
    some = listings(spark, "u7", "u11", "new")
    buckets = tables.buckets_of(some)
    assert 1 <= len(buckets) <= 3
    plan = tables.read_keys(spark, root, buckets)._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in pruned and all(str(b) in pruned for b in buckets)
    assert len([n for n in os.listdir(f"{root}/listing_keys/batch_id=b1") if n.startswith("bucket=")]) > 25
    ids = {r["id"] for r in tables.read_keys(spark, root, buckets).collect()}
    assert {r["id"] for r in listings(spark, "u7", "u11").collect()} <= ids and len(ids) < 80
    flags = {r["inserted"] for r in insert_if_absent(listings(spark, "u7", "u11"), root).collect()}
    assert flags == {False} and len(urls(spark, root)) == 300


def test_batches_without_ids_are_read_from_the_listings(spark, tmp_path):
    """A store from before the table of ids, or a batch broken off between the two."""
    root = str(tmp_path / "store")
    tables.ensure_tables(spark, root)
    tables.write_batch(listings(spark, "old"), root, "listings", "b0")
    log = ingest_batch(raw(spark, "old", "new"), root, "run", **OPTIONS).first()
    assert (log["stored"], log["skipped_dedup"]) == (1, 1) and urls(spark, root) == ["new", "old"]
    tables.compact(spark, root, keep=0)
    assert tables.read_keys(spark, root).count() == 2


def test_fifty_batches_become_few_files(spark, tmp_path):
    root = str(tmp_path / "store")
    tables.ensure_tables(spark, root)
    every = listings(spark, *(f"u{n}" for n in range(50))).toArrow()
    for number in range(50):
        tables.write_listings(spark.createDataFrame(every.slice(number, 1), tables.LISTING_SCHEMA).coalesce(1), root, f"b{number:02d}")
    before = urls(spark, root), sorted(r["id"] for r in tables.read_keys(spark, root).collect())
    assert len(data_files(root, "listings")) == 50
    tables.write_batch(spark.createDataFrame([], tables.TABLES["run_log"]), root, "run_log", "b48")
    tables.write_batch(spark.createDataFrame([], tables.TABLES["run_log"]), root, "run_log", "b49")
    assert tables.compact(spark, root, keep=2) == 48
    assert (urls(spark, root), sorted(r["id"] for r in tables.read_keys(spark, root).collect())) == before
    assert len(data_files(root, "listings")) == 3 and len(data_files(root, "listing_keys")) <= tables.KEY_BUCKETS + 2
    assert tables.merged_batches(spark, root) == {f"b{n:02d}" for n in range(48)}
    assert tables.compact(spark, root, keep=2) == 0
    with pytest.raises(ValueError):
        ingest_batch(raw(spark, "u1"), root, "run", batch_id="b01", **OPTIONS)
    log = ingest_batch(raw(spark, "u1", "u49", "x"), root, "run", batch_id="b50", **OPTIONS).first()
    assert (log["stored"], log["skipped_dedup"]) == (1, 2)
    # the last batches can still be tried again
    log = ingest_batch(raw(spark, "u1", "x", "y"), root, "run", batch_id="b50", **OPTIONS).first()
    assert (log["stored"], log["skipped_dedup"]) == (2, 1) and len(urls(spark, root)) == 52


@pytest.mark.parametrize("listed", [False, True])
def test_a_broken_off_compaction_is_ended(spark, tmp_path, monkeypatch, listed):
    root = str(tmp_path / "store")
    tables.ensure_tables(spark, root)
    for number in range(4):
        tables.write_listings(listings(spark, f"u{number}"), root, f"b{number}")

    def broken(spark, root, name):
        if listed:  # the first table moved in, nothing deleted
            tables.rename_folder(spark, f"{root}/listings/_merged-{name}", f"{root}/listings/batch_id=merged-{name}")
        else:
            os.remove(f"{root}/_compactions/open-{name}/_SUCCESS")
        raise KeyboardInterrupt

    finish = tables._finish_compaction
    monkeypatch.setattr(tables, "_finish_compaction", broken)
    with pytest.raises(KeyboardInterrupt):
        tables.compact(spark, root, keep=0)
    monkeypatch.setattr(tables, "_finish_compaction", finish)
    tables.ensure_tables(spark, root)
    assert urls(spark, root) == ["u0", "u1", "u2", "u3"] and tables.read_keys(spark, root).count() == 4
    assert len(tables.batches(spark, root, "listings")) == (1 if listed else 4)
    assert not [n for t in tables.TABLES for n in os.listdir(f"{root}/{t}") if n.startswith("_merged")]


def test_captures_are_stored_by_source_and_kind(spark, tmp_path):
    rows = [("a", "page", None, "u", "b", 1, 1, None), (None, "feed", None, None, None, None, None, None), ("a b/c", "feed", None, "u", "b", 1, 1, None)]
    captures = spark.createDataFrame(rows, tables.CAPTURE_SCHEMA)
    path = str(tmp_path / "captures")
    for _ in range(2):
        tables.write_captures(captures, path)
    found = tables.read_captures(spark, path)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(rows * 2, key=repr)
    assert os.path.isdir(f"{path}/source=a/kind=page")
    plan = found.filter("source = 'a' and kind = 'page'")._jdf.queryExecution().executedPlan().toString()
    assert "source" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_captures_that_come_source_by_source_are_not_shuffled(spark, tmp_path):
    def of(source, kind):
        rows = [(source, kind, None, f"u{i}", f"body {i} " * 50, 1, i, None) for i in range(40)]
        return spark.createDataFrame(rows, tables.CAPTURE_SCHEMA).coalesce(2)

    captures = of("a", "page").union(of("b", "feed")).union(of("b", "search"))
    path = str(tmp_path / "captures")
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("written", "captures")
    tables.write_captures(captures, path, gather=False)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [len(seen.getJobInfo(job).stageIds) for job in seen.getJobIdsForGroup("written")] == [1]
    assert sorted(map(tuple, tables.read_captures(spark, path).collect()), key=repr) == sorted(map(tuple, captures.collect()), key=repr)
    for folder in ("source=a/kind=page", "source=b/kind=feed", "source=b/kind=search"):
        files = [f"{path}/{folder}/{f}" for f in os.listdir(f"{path}/{folder}") if f.endswith(".parquet")]
        groups = [pq.ParquetFile(f).metadata.row_group(0) for f in files]
        assert len(files) == 2 and {g.column(i).compression for g in groups for i in range(g.num_columns)} == {"ZSTD"}


def test_listings_to_insert_are_computed_once(spark, tmp_path):
    """Ids are decided from a narrow table, not from the listings over and over."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = listings(spark, *[f"u{i}" for i in range(40)], "u1", "u2")
    rows = rows.mapInArrow(counted, rows.schema)
    flags = [r["inserted"] for r in insert_if_absent(rows, str(tmp_path / "store"), "b1").collect()]
    assert flags == [True] * 40 and seen.value == 42


def test_equal_times_go_by_description(spark, tmp_path):
    root, at = str(tmp_path / "store"), F.timestamp_seconds(F.lit(5))
    rows = listings(spark, "a", "b", "c").withColumn("ingested_at", at)
    early = rows.filter("url = 'b'").withColumns({"ingested_at": F.timestamp_seconds(F.lit(4)), "description": F.lit("z")})
    timeless = rows.filter("url = 'c'").withColumns({"ingested_at": F.lit(None).cast("timestamp"), "description": F.lit("y")})
    unnamed = rows.withColumn("id", F.lit(None).cast("string")).withColumn("description", F.concat(F.lit("n"), "url"))
    copies = rows.withColumn("description", F.lit("a text"))
    all_rows = rows.union(copies).union(early).union(timeless).union(unnamed)
    found = {r["id"]: r["inserted"] for r in insert_if_absent(all_rows, root, "b1").collect()}
    assert len(found) == 4 and found.pop(None) is False and all(found.values())
    kept = {(r["id"] is None, r["url"]): r["description"] for r in tables.read_listings(spark, root).collect()}
    assert kept == {(False, "a"): "a text", (False, "b"): "z", (False, "c"): "y", (True, "a"): "na"}
