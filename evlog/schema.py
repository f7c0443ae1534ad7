"""Schemas of the log and its listings."""

from __future__ import annotations

from pyspark.sql import types as T

I64_MAX = 2**63 - 1


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, nullable=False) for k, v in fields.items()])


_L, _S = T.LongType(), T.StringType()

#: One row for each event; meta and data are JSON objects as text.
LOG_SCHEMA = _schema(position=_L, stream=_S, seq=_L, epoch_ms=_L, kind=_S, schema_version=_L, meta=_S, data=_S)
COLUMNS = LOG_SCHEMA.fieldNames()
STREAMS_SCHEMA = _schema(stream=_S, head_seq=_L)
CHECKPOINTS_SCHEMA = _schema(consumer=_S, position=_L, updated_ms=_L)
LEDGER_SCHEMA = _schema(id=_L, applied_ms=_L, plan=_S, removed_count=_L, highest_removed=_L)
RECEIPTS_SCHEMA = T.StructType([*_schema(id=_L, from_position=_L, through=_L, count=_L, whole=T.BooleanType(), taken_ms=_L).fields, T.StructField("landed_ms", _L)])


def check_u63(value: int, what: str) -> int:
    """Positions, cutoffs and sequence numbers are refused, not wrapped, when storage can't hold them."""
    from evlog.errors import Validation

    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= I64_MAX:
        raise Validation(f"{what} must be an integer from 0 to {I64_MAX}, not {value!r}")
    return value
