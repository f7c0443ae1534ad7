"""Schema evolution on read: a chain of steps keyed by kind and version."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog import envelope
from evlog.errors import Corruption
from evlog.schema import COLUMNS, LOG_SCHEMA


@dataclass(frozen=True)
class Upcaster:
    """One step. ``row`` takes and gives an event; ``frame`` is the same on rows of the log schema, as DataFrame operations.

    Without ``frame``, scans run ``row`` in Arrow batches.
    """

    row: Callable[[dict[str, Any]], dict[str, Any]]
    frame: Callable[[DataFrame], DataFrame] | None = None


def current(event: dict[str, Any]) -> dict[str, Any]:
    """What comes out of the chain must still be an event."""
    if not isinstance(event, dict) or not isinstance(event.get("kind"), str):
        raise Corruption("an upcasted event has no kind")
    for k in ("seq", "_schema_version"):
        if isinstance(event.get(k), bool) or not isinstance(event.get(k), int):
            raise Corruption(f"an upcasted event has no {k}")
    return event


def apply_chain(chain: Sequence[Upcaster], event: dict[str, Any]) -> dict[str, Any]:
    for step in chain:
        event = step.row(event)
    return current(event)


def _by_rows(row: Callable[[dict], dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [envelope.to_row(r["position"], r["stream"], current(row(envelope.from_row(r)))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return run


def apply_frames(chain: Sequence[Upcaster], df: DataFrame) -> DataFrame:
    """The chain over a scan, after its filter: filters see stored values."""
    for step in chain:
        df = step.frame(df).select(*COLUMNS) if step.frame else df.mapInArrow(_by_rows(step.row), LOG_SCHEMA)
    if chain:
        for c in ("kind", "seq", "schema_version"):
            df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"an upcasted event has no {c}"))).otherwise(F.col(c)))
    return df
