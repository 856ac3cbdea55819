"""Folders that every executor sees, and tables kept there as Parquet or JSON lines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and the master is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lexwave-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def append(rows: DataFrame, path: str) -> DataFrame:
    """Adds rows to a Parquet table and returns the whole of it."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def replace(rows: DataFrame, path: str) -> DataFrame:
    """Puts rows, which may be read from path itself, in the place of a table: written beside it, then renamed."""
    spark, new = rows.sparkSession, f"{path}-{uuid.uuid4().hex}"
    rows.write.parquet(new)
    delete(spark, path)
    p, fs = _path(spark, new)
    fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(path))
    return spark.read.parquet(path)
