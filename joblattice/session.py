"""Session settings the operators rely on."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Timestamps are rendered as UTC text; JSON objects with a repeated key keep the last value. Batches for
# Python are bounded by bytes, so that a worker's memory doesn't follow the length of pages or texts.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.json.enablePartialResults": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}

_SHIPPED: dict[str, str] = {}

CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "joblattice") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**CLUSTER_CONF, **RUNTIME_CONF}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per Spark application."""
    context = spark.sparkContext
    if _SHIPPED.get("app") != context.applicationId:
        root = Path(__file__).resolve().parent
        target = str(Path(tempfile.mkdtemp(prefix="joblattice-")) / "joblattice")
        context.addPyFile(shutil.make_archive(target, "zip", root.parent, root.name))
        _SHIPPED["app"] = context.applicationId
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session
    runs on one machine (``local[...]``, tests) a local temporary folder takes its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="joblattice-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables through Spark's file system."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.mkdirs(target)


def rename_folder(spark: SparkSession, path: str, new: str) -> None:
    """Give a folder another name; nothing where it is gone (renamed before)."""
    system, source = _file_system(spark, path)
    if system.exists(source) and not system.rename(source, _file_system(spark, new)[1]):
        raise OSError(f"{path} could not be renamed to {new}")


def folders(spark: SparkSession, path: str, files: bool = False) -> list[str]:
    """Names of the folders (or files) in a folder, the one changed last at the end; none if it is not there."""
    system, target = _file_system(spark, path)
    if not system.exists(target):
        return []
    found = [s for s in system.listStatus(target) if s.isDirectory() != files]
    return [s.getPath().getName() for s in sorted(found, key=lambda s: s.getModificationTime())]


def folder_bytes(spark: SparkSession, path: str) -> int:
    system, target = _file_system(spark, path)
    return system.getContentSummary(target).getLength() if system.exists(target) else 0
