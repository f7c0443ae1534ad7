"""Versions of read models: a base and the rows that replaced some of it since, as one frame.

A model's entry in the state names its folders, base first, joined by ``|``.
The key columns of a model that has replacing rows are part of their folder's
name, after ``@``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Replacing folders of a model before they become part of its base.
DELTAS = 16


def keys_of(folder: str) -> list[str]:
    return folder.partition("@")[2].split(",")


def model_frame(spark: SparkSession, manifest, entry: str) -> DataFrame:
    """The model's rows: of equal keys, the newest folder's."""
    base, *deltas = entry.split("|")
    out = spark.read.parquet(manifest.path(base))
    if not deltas:
        return out
    columns, keys = out.columns, keys_of(deltas[-1])
    parts = [spark.read.schema(out.schema).parquet(manifest.path(p)).withColumn("_v", F.lit(i)) for i, p in enumerate((base, *deltas))]
    rows = F.struct("_v", *columns)
    newest = reduce(DataFrame.unionByName, parts).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(rows, "_v").alias("r"))
    return newest.select(*[F.col(f"r.{c}") for c in columns])
