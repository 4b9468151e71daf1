"""Durable intermediates: what is read more than once, or would be made anew after a loss, is written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="framelark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[context.applicationId] = f"file://{folder}"
    return _own[context.applicationId]


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, hadoop = _hadoop(spark, path)
    files.deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Give back the disk of a path that nothing reads any more."""
    files, hadoop = _hadoop(spark, path)
    files.delete(hadoop, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
