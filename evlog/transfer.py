"""Export, import and physical backup."""

from __future__ import annotations

import json
import os
import shutil
from abc import ABC, abstractmethod
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import IO, Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog import envelope, trace
from evlog.errors import StorageError, Validation
from evlog.operators.filters import Filter


#: Files that the driver copies itself.
COPY_FILES = 256


def _copy(batches):
    for batch in batches:
        for row in batch.to_pylist():
            shutil.copy2(row["a"], row["b"])
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])


@dataclass(frozen=True)
class ExportedEvent:
    """A stored event on its way: not upcasted; ``position`` is where it was, if that is known."""

    stream: str
    position: int | None
    event: dict[str, Any]

    def to_json(self) -> dict[str, Any]:
        return {"stream": self.stream} | ({} if self.position is None else {"position": self.position}) | {"event": self.event}

    @staticmethod
    def from_json(value: Any) -> ExportedEvent:
        if not isinstance(value, dict):
            raise Validation("a record is an object")
        stream, position = value.get("stream"), value.get("position")
        if not isinstance(stream, str) or not stream:
            raise Validation("a record's stream is a non-empty string")
        if position is not None and (isinstance(position, bool) or not isinstance(position, int) or position < 0):
            raise Validation("a record's position is a non-negative integer")
        if "event" not in value:
            raise Validation("a record has an event")
        envelope.validate_stored(value["event"])
        return ExportedEvent(stream, position, value["event"])


@dataclass(frozen=True)
class ImportReport:
    imported: int
    first: int | None
    last: int | None
    reproduced_coordinates: bool


class Sink(ABC):
    """Takes pages of exported events; a page that returned is safe."""

    @abstractmethod
    def write(self, page: list[ExportedEvent]) -> None: ...


class JsonLinesSink(Sink):
    """One record a line, flushed after every page."""

    def __init__(self, out: IO[str]):
        self.out = out

    def write(self, page: list[ExportedEvent]) -> None:
        for e in page:
            self.out.write(json.dumps(e.to_json(), ensure_ascii=False, separators=(",", ":")) + "\n")
        self.out.flush()


class FrameSink(Sink):
    """Takes a whole export at once, as a frame (position, record) that Spark writes."""

    def __init__(self, path: str):
        self.path = path

    def write(self, page: list[ExportedEvent]) -> None:
        raise Validation("this sink takes frames")

    def write_frame(self, frame: DataFrame) -> None:
        """A folder of JSON Lines for each export, named by its first position."""
        first = frame.agg(F.min("position")).first()[0]
        frame.sortWithinPartitions("position").select("record").write.text(os.path.join(self.path, f"{first:020d}"))


class LogSink(Sink):
    """Imports every page into another log; an empty page is no write."""

    def __init__(self, log: Transfer):
        self.log, self.reports = log, []

    def write(self, page: list[ExportedEvent]) -> None:
        if page:
            self.reports.append(self.log.import_records(page))

    @property
    def imported(self) -> int:
        return sum(r.imported for r in self.reports)

    @property
    def reproduced_coordinates(self) -> bool:
        return all(r.reproduced_coordinates for r in self.reports)


class Transfer:
    """Part of ``EventLog``."""

    def export(self, from_: int = 0, f: Filter = Filter(), limit: int | None = None) -> list[ExportedEvent]:
        """Stored events after a position, in order, as they were written."""
        rows = self._rows(self.manifest.refresh(), from_, f, limit)
        return [ExportedEvent(r["stream"], r["position"], e) for r, e in zip(rows, envelope.from_rows(rows), strict=True)]

    def export_frame(self, from_: int = 0, f: Filter = Filter()) -> DataFrame:
        """(position, record): the same as JSON records, for bulk; ``.select('record').write.text`` makes JSON Lines."""
        return records(self.stored(from_, f))

    def import_records(self, records: Iterable[ExportedEvent]) -> ImportReport:
        """One commit: new coordinates in the given order; time and version stay."""
        records = list(records)
        if not records:
            return ImportReport(0, None, None, True)
        return ImportReport(*self.with_transaction(lambda t: t.import_many([(r.stream, r.position, r.event) for r in records])))

    def import_frame(self, df: DataFrame, order: list[str]) -> ImportReport:
        """Bulk import of stored rows (stream, epoch_ms, kind, schema_version, meta, data), any table mapped to those.

        With a column ``position`` (where a row was; null if unknown) or ``seq``, the report says whether every row landed there.
        """
        came = [F.lit(True)]
        for c, name in (("position", "_came"), ("seq", "_came_seq")):
            if c in df.columns:
                df = df.withColumnRenamed(c, name)
                order = [name if o == c else o for o in order]
                came.append(F.col(name).isNull() | (F.col(name) == F.col(c)))
        return ImportReport(*self._append_frame(df, order, reduce(Column.__and__, came)))

    def backup_to(self, path: str) -> None:
        """A consistent copy as of one commit; the destination must not exist, and goes again if the copy fails."""
        with trace.span("backup"):
            if os.path.exists(path):
                raise Validation(f"{path} exists")
            state = self.manifest.refresh()
            os.makedirs(path)
            try:
                for d in ("_log", "segments", "models", "tables", "counters", "tmp"):
                    os.makedirs(os.path.join(path, d))
                pairs = [(self.manifest.check(s), os.path.join(path, s.path)) for s in state.segments.values()]
                for d in {os.path.dirname(b) for _, b in pairs}:
                    os.makedirs(d, exist_ok=True)
                if len(pairs) > COPY_FILES:  # many files are copied by the executors
                    self.spark.createDataFrame(pairs, "a string, b string").repartition(len(pairs) // 16 + 1).mapInArrow(_copy, "n bigint").agg(F.sum("n")).collect()
                else:
                    with ThreadPoolExecutor(8) as pool:
                        list(pool.map(lambda p: shutil.copy2(*p), pairs))
                for p in [*state.counters, *(x for m in state.models.values() for x in m.split("|")), *state.tables.values()]:
                    shutil.copytree(self.manifest.path(p), os.path.join(path, p))
                with open(os.path.join(path, "_log", f"{max(1, state.n):020d}.state.json"), "w", encoding="utf-8") as f:
                    json.dump(state.dump() | {"n": max(1, state.n)}, f, ensure_ascii=False)
            except OSError as e:
                shutil.rmtree(path, ignore_errors=True)
                raise StorageError(str(e)) from e
            except BaseException:
                shutil.rmtree(path, ignore_errors=True)
                raise


def records(rows: DataFrame) -> DataFrame:
    """(position, record) of stored rows, each as its JSON record."""
    event = F.concat(F.lit('{"kind":'), _quoted("kind"), F.lit(',"meta":'), "meta", F.lit(',"data":'), "data", F.lit(',"_schema_version":'), "schema_version", F.lit(',"seq":'), "seq", F.lit(',"epoch_ms":'), "epoch_ms", F.lit("}"))
    return rows.select("position", F.concat(F.lit('{"stream":'), _quoted("stream"), F.lit(',"position":'), "position", F.lit(',"event":'), event, F.lit("}")).alias("record"))


def _quoted(column: str):
    """The column as a JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(F.col(column).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def read_json_lines(lines: Iterable[str]) -> list[ExportedEvent]:
    out = []
    for line in lines:
        if line.strip():
            try:
                out.append(ExportedEvent.from_json(json.loads(line)))
            except ValueError as e:
                raise Validation(f"a line isn't JSON: {e}") from e
    return out
