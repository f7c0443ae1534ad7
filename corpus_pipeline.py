"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``. Packing needs a tokenizer, so SQL can't express
the result: ``ORACLE_SQL`` is None, and tests hold every stage against a
brute-force version.

Defined cases are those of the operators. Stages decide on rows, which they
number, not on ids: texts under one id or a null id are documents of their own.
Rows that repeat with id and text are one group of copies: one row stays.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog.llm import decontaminate, language_id, near_dedup, packing, suffix_dedup
from evlog.llm.queries import tokenizer_path
from evlog.llm.sparkio import dropped, stored, table

#: Ids sent to all workers at most; beyond it, joins shuffle.
BROADCAST_IDS = 400_000


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs``, written with a number for each row (``__row``)."""
    return stored(docs.withColumn("__row", F.monotonically_increasing_id()))


def _by_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    rows = stored(rows.select("__row"))
    side = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    return docs.join(side, "__row", how).drop("__row")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be recognised (no text, or no letter in it) go."""
    learned = language_id.samples(docs, F.lit(True))
    found = language_id.identify(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text")), learned)
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).select("doc.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (one without an id if none has one)."""
    rows = _numbered(docs)
    found = near_dedup.near_duplicates(rows, id_col="__row")
    own = rows.select("__row", "doc_id", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256).alias("digest"), F.col("text").isNull().alias("none"))
    # texts without words are linked with nothing: of those, only rows equal in id and text are one group
    alone = F.when(F.col("n_shingles") == 0, F.struct("doc_id", "none", "digest"))
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "__row")).alias("first")
    kept = found.join(own, "__row").groupBy(group.alias("group"), alone.alias("alone")).agg(first).select("first.__row")
    return _by_row(rows, kept, "left_semi")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a repeated 200-byte string is cut out; a character that a cut splits goes with it."""

    @F.arrow_udf("string")
    def decoded(data: pa.Array) -> pa.Array:
        return pa.array([None if b is None else b.decode("utf-8", "ignore") for b in data.to_pylist()], pa.string())

    cut = suffix_dedup.dedup(docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), F.col("text")))
    changed = F.col("n_removed") > 0
    cut = cut.select("doc", "n_removed", F.when(changed, decoded(F.when(changed, F.col("kept")))).otherwise(F.col("text")).alias("text"))
    size = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return cut.select(*[F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go."""
    rows = _numbered(docs)
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col="__row")
    return _by_row(rows, found.where("contaminated"), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder before the next stage."""
    docs, written = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        dropped(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
