"""The event envelope: what callers may write, what storage adds."""

from __future__ import annotations

import json
import time
from typing import Any

from evlog.errors import Corruption, Validation
from evlog.schema import I64_MAX

CALLER_KEYS = ("kind", "meta", "data", "_schema_version")
STORE_KEYS = ("seq", "epoch_ms")
DEFAULT_VERSION = 1

Event = dict[str, Any]


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def _integer(event: Event, key: str) -> None:
    v = event[key]
    if isinstance(v, bool) or not isinstance(v, int) or not 0 <= v <= I64_MAX:
        raise Validation(f"{key} must be a non-negative 64-bit integer")


def _check_body(event: Event) -> None:
    if not isinstance(event, dict):
        raise Validation("an event is an object")
    kind = event.get("kind")
    if not isinstance(kind, str) or not kind:
        raise Validation("kind must be a non-empty string")
    if "data" in event and not isinstance(event["data"], dict):
        raise Validation("data must be an object")
    meta = event.get("meta", {})
    if not isinstance(meta, dict):
        raise Validation("meta must be an object")
    for k, v in meta.items():
        if not isinstance(v, str | int | float | bool):
            raise Validation(f"meta.{k} must be a string, a number or a boolean")
    if "_schema_version" in event:
        _integer(event, "_schema_version")
    try:
        json.dumps({"meta": meta, "data": event.get("data", {})}, allow_nan=False)
    except (TypeError, ValueError) as e:
        raise Validation(f"meta and data must be JSON: {e}") from e


def validate(event: Event) -> None:
    """A new event: the caller's keys only."""
    _check_body(event)
    for k in event:
        if k in STORE_KEYS:
            raise Validation(f"{k} is set by the store")
        if k not in CALLER_KEYS:
            raise Validation(f"unknown key {k}")


def validate_stored(event: Event) -> None:
    """An event that was stored before: coordinates allowed, time and version required."""
    _check_body(event)
    for k in event:
        if k not in CALLER_KEYS and k not in STORE_KEYS:
            raise Validation(f"unknown key {k}")
    for k in ("epoch_ms", "_schema_version"):
        if k not in event:
            raise Validation(f"{k} is missing")
    for k in STORE_KEYS:
        if k in event:
            _integer(event, k)


def stamp(event: Event, seq: int, epoch_ms: int) -> Event:
    return {"kind": event["kind"], "meta": event.get("meta", {}), "data": event.get("data", {}), "_schema_version": event.get("_schema_version", DEFAULT_VERSION), "seq": seq, "epoch_ms": epoch_ms}


def restamp(stored: Event, seq: int) -> Event:
    """A stored event at a new place: its time and version stay."""
    return stamp(stored, seq, stored["epoch_ms"])


def text(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def to_row(position: int, stream: str, event: Event) -> dict[str, Any]:
    return {"position": position, "stream": stream, "seq": event["seq"], "epoch_ms": event["epoch_ms"], "kind": event["kind"], "schema_version": event["_schema_version"], "meta": text(event["meta"]), "data": text(event["data"])}


def from_row(row: dict[str, Any]) -> Event:
    """The stored object of a row; text that isn't a JSON object is corruption, never an empty object."""
    body = {}
    for k in ("meta", "data"):
        try:
            body[k] = json.loads(row[k])
        except (TypeError, ValueError) as e:
            raise Corruption(f"{k} at position {row['position']} isn't JSON") from e
        if not isinstance(body[k], dict):
            raise Corruption(f"{k} at position {row['position']} isn't an object")
    return {"kind": row["kind"], **body, "_schema_version": row["schema_version"], "seq": row["seq"], "epoch_ms": row["epoch_ms"]}


def from_rows(rows: list[dict[str, Any]]) -> list[Event]:
    """As ``from_row``, with one parse for each column; rows that don't come out one object each are looked at singly."""
    bodies = []
    for k in ("meta", "data"):
        try:
            found = json.loads(f"[{','.join([r[k] for r in rows])}]")
        except (TypeError, ValueError):
            found = []
        if len(found) != len(rows) or not all(type(v) is dict for v in found):
            return [from_row(r) for r in rows]
        bodies.append(found)
    return [{"kind": r["kind"], "meta": m, "data": d, "_schema_version": r["schema_version"], "seq": r["seq"], "epoch_ms": r["epoch_ms"]} for r, m, d in zip(rows, *bodies, strict=True)]
