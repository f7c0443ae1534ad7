"""JSON-Lines records in bulk: parsed and checked by Spark, ready for ``import_frame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog.schema import I64_MAX


def _piece(record, path: str, kind: str):
    return F.try_variant_get(record, path, kind)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(ord, witness, stream, seq, epoch_ms, kind, schema_version, meta, data) of each line; a line that is no record fails the read.

    ``ord`` is the order to import in: the record's own position where it has one, else its place in the input.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("i", F.monotonically_increasing_id())
    r = lines.select("i", "value", F.try_parse_json("value").alias("r"))
    get = lambda p, t: _piece(F.col("r"), p, t)
    parts = r.select(
        "i", "value", get("$.position", "bigint").alias("witness"), get("$.stream", "string").alias("stream"), get("$.event.seq", "bigint").alias("seq"),
        get("$.event.epoch_ms", "bigint").alias("epoch_ms"), get("$.event.kind", "string").alias("kind"), get("$.event._schema_version", "bigint").alias("schema_version"),
        F.coalesce(F.to_json(get("$.event.meta", "variant")), F.lit("{}")).alias("meta"), F.coalesce(F.to_json(get("$.event.data", "variant")), F.lit("{}")).alias("data"),
    )
    whole = lambda c: F.col(c).isNotNull() & F.col(c).between(0, I64_MAX)
    good = (F.length("stream") > 0) & (F.length("kind") > 0) & whole("epoch_ms") & whole("schema_version") & F.col("meta").startswith("{") & F.col("data").startswith("{") & (F.coalesce("witness", F.lit(0)) >= 0)
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("stream")).otherwise(F.raise_error(F.lit("a line is no record")))
    return parts.select(F.coalesce("witness", "i").alias("ord"), "witness", checked.alias("stream"), "seq", "epoch_ms", "kind", "schema_version", "meta", "data")
