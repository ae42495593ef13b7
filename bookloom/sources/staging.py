"""Tables in the folder that driver and executors share: steps written once, so that later plans read rows, not lineage.

They survive lost executors. discard() deletes those that no later plan reads; the rest goes when the driver's JVM ends.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir and all its executors are threads of the driver, as in tests.
LOCAL_DIR = "/tmp/checkpoints"
#: Rows of a file, and the least number of files, of tables whose size is known to be small beside the shuffle's partitions.
#: Every file costs a store's calls, and local stores a process each, so hundreds of files of a few rows are worse than few.
FILE_ROWS, LEAST_FILES = 1 << 16, 8
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or LOCAL_DIR).rstrip('/')}/bookloom/{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def _shuffles_go(spark: SparkSession):
    """Shuffle files of what is written here go when that is done: nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again. rows: a bound of its narrow rows, where one is known;
    files are then no more than these need."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.parquet(path)
    p, fs = _file_system(spark, path)
    fs.deleteOnExit(p.getParent())
    out = spark.read.schema(df.schema).parquet(path)
    out._bookloom_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of staged() that no later plan reads."""
    for df in tables:
        if df is not None and (path := getattr(df, "_bookloom_path", None)):
            p, fs = _file_system(df.sparkSession, path)
            fs.delete(p, True)
