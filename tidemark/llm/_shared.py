"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tidemark.ship import ship

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def ready(spark: SparkSession) -> None:
    """Send the package to the workers, and let no Arrow batch hold more than ``BATCH_BYTES``, or one row, so that they hold little at once.

    The latter is a setting of the session; a smaller one stays.
    """
    ship(spark)
    held = spark.conf.get(BATCH, "64m").lower()
    size = int(held.rstrip("kmgb")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(held.rstrip("b")[-1:], 1)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`keep` writes inside are deleted at the end, but for those that ``stay``."""
    path = f"{shared_dir(spark)}/passing-{uuid.uuid4().hex}"
    token = FOLDER.set(path)
    try:
        yield
    finally:
        FOLDER.reset(token)
        _delete(spark, path)


def keep(df: DataFrame, name: str, stay: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    folder = None if stay else FOLDER.get()
    path = f"{folder or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`keep` once no later step reads it."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
