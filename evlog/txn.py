"""A transaction: appends, reads of its own writes and caller tables, in one commit."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import DataFrame

from evlog import envelope
from evlog.errors import HeadMismatch, Unsupported, Validation
from evlog.operators.filters import Filter
from evlog.operators.upcast import apply_chain
from evlog.schema import I64_MAX, check_u63
from evlog.store.manifest import State

if TYPE_CHECKING:
    from evlog.log import EventLog

ARROW = pa.schema([("position", pa.int64()), ("stream", pa.string()), ("seq", pa.int64()), ("epoch_ms", pa.int64()), ("kind", pa.string()), ("schema_version", pa.int64()), ("meta", pa.string()), ("data", pa.string())])

#: Names that callers can't give their tables. Fixed values.
RESERVED = ("events", "stream_seq", "checkpoints", "retention", "exports", "segments", "models")


class Committed(tuple):
    """(seq, epoch_ms, position): where a write landed; position is None for a log without one."""

    __slots__ = ()
    seq = property(lambda s: s[0])
    epoch_ms = property(lambda s: s[1])
    position = property(lambda s: s[2])

    def __new__(cls, seq: int, epoch_ms: int, position: int | None = None):
        return super().__new__(cls, (seq, epoch_ms, position))


class Transaction:
    """Buffers until the log commits it. It has no commit or rollback of its own: leaving the block does that."""

    def __init__(self, log: EventLog, state: State):
        self.log, self.state = log, state
        self.rows: list[dict[str, Any]] = []
        self.seqs: dict[str, int] = {}
        self.position = state.next_position
        self.changes: dict[str, Any] = {}

    def _next_seq(self, stream: str) -> int:
        if stream not in self.seqs:
            self.seqs[stream] = self.log.manifest.next_seq(self.state, stream)
        return self.seqs[stream]

    def _put(self, stream: str, event: dict[str, Any]) -> Committed:
        if not isinstance(stream, str) or not stream:
            raise Validation("a stream has a non-empty name")
        if self.position > I64_MAX:
            raise Validation("the log is full")
        self.rows.append(envelope.to_row(self.position, stream, event))
        self.seqs[stream] = event["seq"] + 1
        self.position += 1
        return Committed(event["seq"], event["epoch_ms"], self.position - 1)

    def append(self, stream: str, event: dict[str, Any]) -> Committed:
        return self.append_many(stream, [event])[0]

    def append_at(self, stream: str, epoch_ms: int, event: dict[str, Any]) -> Committed:
        return self.append_many_at(stream, epoch_ms, [event])[0]

    def append_many(self, stream: str, events: Iterable[dict[str, Any]]) -> list[Committed]:
        """All or nothing, with one reading of the clock."""
        return self.append_many_at(stream, envelope.now_ms(), events)

    def append_many_at(self, stream: str, epoch_ms: int, events: Iterable[dict[str, Any]]) -> list[Committed]:
        events = list(events)
        check_u63(epoch_ms, "epoch_ms")
        for e in events:
            envelope.validate(e)
        return [self._put(stream, envelope.stamp(e, self._next_seq(stream), epoch_ms)) for e in events]

    def append_expecting(self, stream: str, expected: int | None, event: dict[str, Any]) -> Committed:
        """``expected``: the stream's last sequence number ever given, or None for a stream never written."""
        actual = self._next_seq(stream) - 1 or None
        if expected != actual:
            raise HeadMismatch(expected, actual)
        return self.append(stream, event)

    def import_many(self, records: Iterable[tuple[str, int | None, dict[str, Any]]]) -> tuple[int, int | None, int | None, bool]:
        """(imported, first position, last position, whether every record landed on its own coordinates)."""
        records = list(records)
        for _, _, e in records:
            envelope.validate_stored(e)
        first, same = self.position, True
        for stream, witness, e in records:
            c = self._put(stream, envelope.restamp(e, self._next_seq(stream)))
            same &= (witness is None or witness == c.position) and e.get("seq", c.seq) == c.seq
        return (len(records), first, self.position - 1, same) if records else (0, None, None, True)

    def read(self, stream: str, kinds: Iterable[str] | None = None, from_seq: int = 0, limit: int | None = None) -> list[dict[str, Any]]:
        """As the stream's own read, with what this transaction wrote."""
        if limit == 0:
            return []
        f = Filter() if kinds is None else Filter.of_kinds(kinds)
        own = [envelope.from_row(r) for r in self.rows if r["stream"] == stream]
        own = [apply_chain(self.log.upcasters, e) for e in own if e["seq"] >= from_seq and f.matches(stream, e["kind"], e["meta"])]
        return (self.log._read_stream(self.state, stream, f, from_seq, limit) + own)[:limit]

    def head(self, stream: str) -> int | None:
        own = [r["seq"] for r in self.rows if r["stream"] == stream]
        return max(own) if own else self.log._stream_head(self.state, stream)

    def checkpoint_save(self, consumer: str, position: int) -> None:
        self.changes.setdefault("checkpoints", {})[consumer] = [check_u63(position, "position"), envelope.now_ms()]

    def checkpoint_load(self, consumer: str) -> int:
        return self.changes.get("checkpoints", {}).get(consumer, self.state.checkpoints.get(consumer, [0]))[0]

    def put_table(self, name: str, df: DataFrame) -> None:
        """Create or replace a caller table; it becomes visible with the commit."""
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise Validation(f"{name!r} is no table name")
        if name.lower() in RESERVED:
            raise Unsupported(f"{name} belongs to the log")
        path = f"tables/{name}/{uuid.uuid4().hex}"
        df.write.parquet(self.log.manifest.path(path))
        self.changes.setdefault("tables", {})[name] = path

    def drop_table(self, name: str) -> None:
        if name.lower() in RESERVED:
            raise Unsupported(f"{name} belongs to the log")
        self.changes.setdefault("tables", {})[name] = None

    def upsert_table(self, name: str, df: DataFrame, key: list[str]) -> None:
        """Rows of ``df`` replace rows of the table with equal key."""
        old = self.table(name)
        self.put_table(name, df if old is None else old.join(df.select(*key).distinct(), key, "left_anti").unionByName(df))

    def tables(self) -> dict[str, str | None]:
        """Caller tables as this transaction sees them."""
        return {**self.state.tables, **self.changes.get("tables", {})}

    def table(self, name: str) -> DataFrame | None:
        path = self.changes.get("tables", {}).get(name, self.state.tables.get(name))
        return self.log.spark.read.parquet(self.log.manifest.path(path)) if path else None

    def execute(self, sql: str, params: Any = None) -> None:
        """CREATE TABLE, DROP TABLE, INSERT, UPDATE, DELETE on caller tables; a query in it sees the log and this transaction's tables."""
        from evlog import hatch

        hatch.execute(self, sql, params)

    def commit(self) -> None:
        change = dict(self.changes)
        if self.rows:
            self.log._check_unique(self.state, self.rows)
            m, keys = self.log.manifest, self.log.index_keys(self.state)
            add, remove = [m.write_segment(pa.Table.from_pylist(self.rows, schema=ARROW), keys)], []
            if crowd := self.state.crowded():
                add.append(m.merge(crowd, ARROW, keys))
                remove = [s.path for s in crowd]
            change |= {"add": add, "remove": remove, "next_position": self.position, "stream_seq": self.seqs}
        if change:
            self.log.manifest.publish(change)
