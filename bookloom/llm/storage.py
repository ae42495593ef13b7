"""Tables in the shared folder, and workers that find this package."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from bookloom.sources.staging import discard, shared_dir
from bookloom.sources.staging import staged as materialize

__all__ = ["discard", "fresh_path", "is_there", "materialize", "shared_dir", "ship"]

#: Bytes of rows that go to a Python worker at once; long texts are then few to a batch.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def is_there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _bytes(text: str) -> int:
    """Of a setting in bytes; what isn't a plain positive number, or isn't there, bounds nothing."""
    digits = text.strip().lower().removesuffix("b")
    return int(digits) if digits.isdigit() and int(digits) > 0 else 1 << 62


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it is not installed: they get the driver's path to it.

    Clusters whose executors don't see that path install the package or pass it with --py-files. Batches of rows for
    workers are bounded by BATCH_BYTES, unless the session sets less.
    """
    spark.conf.set(_BATCH, str(min(BATCH_BYTES, _bytes(spark.conf.get(_BATCH)))))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (root, env.get("PYTHONPATH"))))
    return spark
