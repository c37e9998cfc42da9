"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_run_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where that is unset and all runs on one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if context.applicationId not in _own_dir:
        _own_dir[context.applicationId] = tempfile.mkdtemp(prefix="lodestone-")
    return _own_dir[context.applicationId]


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes with the application."""
    app = spark.sparkContext.applicationId
    if app not in _run_dirs:
        path = f"{shared_dir(spark).rstrip('/')}/lodestone-{app}"
        files, at = _file_system(spark, path)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _run_dirs[app] = path
    return _run_dirs[app]


def release(spark: SparkSession) -> None:
    """Removes what this application has written so far; results that are not read yet cannot be read any more."""
    path = _run_dirs.pop(spark.sparkContext.applicationId, None)
    if path:
        files, at = _file_system(spark, path)
        files.delete(at, True)


def scratch(spark: SparkSession, what: str) -> str:
    """A path in this application's folder that nothing else uses."""
    return f"{run_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
