"""Positions and sequence numbers for bulk writes, without a global sort into one task.

Rows are range-partitioned by their order; a count of each partition gives its
first position, a count of each stream in each partition its first sequence
number there. A stream of a third of all rows is thus numbered in many tasks.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(df: DataFrame, order: Sequence[str], partitions: int) -> DataFrame:
    return df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only where that is unset, as in tests."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else "file://" + os.path.join(tempfile.gettempdir(), "evlog-checkpoints"))


def assign(staged: DataFrame, head: int, counters: DataFrame | None) -> DataFrame:
    """``position`` and ``seq`` for rows of ``ordered`` that were written and read back.

    ``counters``: (stream, next_seq), one row for a stream that was written before.
    """
    sizes = staged.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_base"))  # a row for each partition
    cells = staged.groupBy("stream", "_p").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("stream", "_p", (F.sum("n").over(Window.partitionBy("stream").orderBy("_p")) - F.col("n")).alias("_before"))
    rank = F.col("_i").bitwiseAND(F.lit(2**33 - 1)) + 1  # ``_i`` counts the rows of a partition in its low bits: no window, which would deal whole partitions to tasks by hash
    own = F.row_number().over(Window.partitionBy("_p", "stream").orderBy("_i"))
    out = staged.withColumn("_r", rank).withColumn("_s", own).join(F.broadcast(sizes), "_p").join(cells, ["stream", "_p"])
    first = F.lit(1)
    if counters is not None:
        out = out.join(counters.select("stream", "next_seq"), "stream", "left")
        first = F.coalesce("next_seq", F.lit(1))
    return out.withColumn("position", (F.lit(head) + F.col("_base") + F.col("_r")).cast("bigint")).withColumn("seq", (first - 1 + F.col("_before") + F.col("_s")).cast("bigint"))
