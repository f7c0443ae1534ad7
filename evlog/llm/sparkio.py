"""Small Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a folder of our own only where that is unset."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if where is None:
        where = "file://" + os.path.join(tempfile.gettempdir(), "evlog-checkpoints")
    return where


#: Bytes of an Arrow batch between the JVM and a Python worker, where the session sets no other.
BATCH_BYTES = 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
_FOLDERS: dict[str, SparkSession] = {}


def sized(spark: SparkSession) -> None:
    """Batches of texts are small in bytes: both sides of a Python worker hold several at once."""
    if spark.conf.get(_BATCHES) == "67108864b":  # Spark's own default
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    """Results are lazy, so what they read stays until the application ends; then its folder goes."""
    for path, spark in _FOLDERS.items():
        with suppress(Exception):  # the session may have ended already
            _delete(spark, path)


def scratch(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    path = f"{shared_dir(spark).rstrip('/')}/evlog-{spark.sparkContext.applicationId}"
    _FOLDERS.setdefault(path, spark)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: cuts its lineage, and a lost executor loses none of it."""
    spark = df.sparkSession
    sized(spark)
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these frames; call it when nothing reads them any more."""
    for df in frames:
        _delete(df.sparkSession, df._stored_at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sized(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
