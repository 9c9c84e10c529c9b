"""Paths in any file system that Spark reaches, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all that is in a folder."""
    where, fs = _at(spark, path)
    return fs.getContentSummary(where).getLength()


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a file or a folder with all that is in it; whether it was there."""
    where, fs = _at(spark, path)
    return fs.delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in local mode."""
    sc = spark.sparkContext
    if (folder := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return folder
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(rows: DataFrame) -> DataFrame:
    """rows from a new folder in the shared one, so that plans that use them twice see the same rows in the same partitions' numbers."""
    path = f"{shared_folder(rows.sparkSession)}/corvane-rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    where, fs = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A new small file; FileExistsError if there is one."""
    where, fs = _at(spark, path)
    if fs.exists(where):
        raise FileExistsError(path)
    out = fs.create(where, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _at(spark, path)
    source = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(source)).decode()
    finally:
        source.close()
