"""Projections: read models that move together with their cursor, in one commit."""

from __future__ import annotations

import threading
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog import trace
from evlog.errors import StorageError, Truncated, Validation
from evlog.log import EventLog
from evlog.operators.filters import Filter
from evlog.operators.upcast import apply_frames
from evlog.schema import LOG_SCHEMA
from evlog.store.manifest import State
from evlog.store.models import DELTAS, model_frame
from evlog.txn import ARROW, Transaction

BATCH = 256
#: Batches behind from which on catching up is one Spark job over all of them.
BULK_BATCHES = 4


class Projection(ABC):
    """A fold of events into a table.

    ``apply`` gets a batch (rows of the log schema, in current shape) and the
    model so far, and returns the new model; with ``keys``, it returns only the
    rows that replace those of equal keys, and a batch costs what it changes.
    It is declarative: Spark runs it; if it fails, neither model nor cursor moves.
    """

    name: str = ""
    kinds: Iterable[str] | None = None
    tolerates_truncation: bool = False
    keys: Sequence[str] = ()

    @abstractmethod
    def init(self, log: EventLog) -> DataFrame:
        """The empty model."""

    def reset(self, log: EventLog) -> DataFrame:
        """The model that a rebuild begins with."""
        return self.init(log)

    @abstractmethod
    def apply(self, batch: DataFrame, model: DataFrame) -> DataFrame: ...


class ProjectionRunner:
    """The one live runner of a projection's name on a log handle."""

    def __init__(self, log: EventLog, projection: Projection, batch: int = BATCH):
        if not projection.name:
            raise Validation("a projection has a name")
        if projection.name in log.runners:
            raise Validation(f"{projection.name} has a live runner")
        log.runners.add(projection.name)
        self.log, self.projection, self.batch, self.lost = log, projection, max(1, batch), False

    def __enter__(self) -> ProjectionRunner:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.log.runners.discard(self.projection.name)

    def into_inner(self) -> Projection:
        self.close()
        return self.projection

    def with_batch(self, batch: int) -> ProjectionRunner:
        self.batch = max(1, batch)
        return self

    def position(self) -> int:
        return self.log.checkpoint_load(self.projection.name)

    def model(self) -> DataFrame:
        return self._model(self.log.manifest.refresh())

    def _model(self, state: State) -> DataFrame:
        entry = state.models.get(self.projection.name)
        return model_frame(self.log.spark, self.log.manifest, entry) if entry else self.projection.init(self.log)

    def _filter(self) -> Filter:
        return Filter() if self.projection.kinds is None else Filter.of_kinds(self.projection.kinds)

    @contextmanager
    def _step(self) -> Iterator[Transaction]:
        """A transaction of this runner. If its commit may or may not have landed, the runner is no use any more."""
        if self.lost:
            raise StorageError("the runner failed and can't be used again")
        try:
            with self.log.transaction() as txn:
                yield txn
        except (StorageError, OSError) as e:
            self.lost = True
            raise StorageError(f"the runner is lost: {e}") from e

    def _write(self, df: DataFrame, folder: str) -> str:
        df.write.parquet(self.log.manifest.path(folder))
        return folder

    def _fold(self, txn: Transaction, batch: DataFrame) -> None:
        """A batch into the transaction's model."""
        own, name = self.projection, self.projection.name
        entry, model = txn.state.models.get(name), self._model(txn.state)
        rows = own.apply(apply_frames(self.log.upcasters, batch), model)
        new = f"models/{name}/{uuid.uuid4().hex}"
        if not own.keys:
            entry = self._write(rows, new)
        else:
            entry = entry or self._write(own.init(self.log), f"{new}base")
            entry = f"{entry}|{self._write(rows.select(*model.columns), f'{new}@{",".join(own.keys)}')}"
            if entry.count("|") > DELTAS:
                entry = self._write(model_frame(self.log.spark, self.log.manifest, entry), f"{new}base")
        txn.changes["models"] = {name: entry}

    def run_once(self) -> int:
        """At most a batch of events into the model; how many were applied.

        The cursor goes to the last event of a full batch, and to the head after a short one.
        """
        log, name = self.log, self.projection.name
        with trace.span("project", projection=name) as seen, self._step() as txn:
            cursor = txn.checkpoint_load(name)
            if not self.projection.tolerates_truncation:
                log.require_complete_from(cursor, txn.state)
            rows = log._rows(txn.state, cursor, self._filter(), self.batch)
            last = rows[-1]["position"] if rows else cursor
            if rows:
                table = pa.Table.from_pylist(rows, schema=ARROW)  # read once
                self._fold(txn, log.spark.createDataFrame(table, LOG_SCHEMA))
            through = last if len(rows) == self.batch else max(last, txn.state.head)
            if rows or through != cursor:
                txn.checkpoint_save(name, through)
            seen["applied"] = len(rows)
            return len(rows)

    def run_frame(self, rows: DataFrame, through: int) -> int:
        """Rows of the log up to a position, as one batch that stays distributed; those at or before the cursor are passed over."""
        log, name = self.log, self.projection.name
        with trace.span("project", projection=name) as seen, self._step() as txn:
            cursor = txn.checkpoint_load(name)
            if not self.projection.tolerates_truncation:
                log.require_complete_from(cursor, txn.state)
            if through <= cursor:
                return 0
            batch = rows.where(F.col("position") > cursor).where(F.col("position") <= through).where(self._filter().column())
            n = batch.count()
            if n:
                self._fold(txn, batch)
            txn.checkpoint_save(name, through)
            seen["applied"] = n
            return n

    def catch_up_bulk(self) -> int:
        """All that is behind, as one distributed batch: for histories that don't belong on the driver."""
        state = self.log.manifest.refresh()
        cursor = self.position()
        return self.run_frame(self.log.stored(cursor, self._filter(), state), state.head)

    def catch_up(self) -> int:
        """Until nothing is behind. A runner that is many batches behind begins with one distributed batch."""
        state = self.log.manifest.refresh()
        far = sum(s.rows for s in state.segments.values() if s.max_position > self.position()) > BULK_BATCHES * self.batch
        total = self.catch_up_bulk() if far else 0
        while n := self.run_once():
            total += n
        return total

    def follow(self, stop: threading.Event) -> None:
        """Catch up, wait for a commit or the poll interval, again; an error ends it."""
        while not stop.is_set():
            with self.log.manifest.wake:
                n = self.log.manifest.state.n  # before reading: a commit in between isn't missed
            self.catch_up()
            with self.log.manifest.wake:
                if self.log.manifest.state.n <= n + 1:
                    self.log.manifest.wake.wait(self.log.options.poll_ms / 1000)

    def rebuild(self) -> int:
        """From the beginning; refused before anything is emptied if history was removed."""
        own, name = self.projection, self.projection.name
        with self._step() as txn:
            if not own.tolerates_truncation and txn.state.watermark > 0:
                raise Truncated(0, txn.state.watermark)
            txn.changes["models"] = {name: self._write(own.reset(self.log), f"models/{name}/{uuid.uuid4().hex}")}
            txn.checkpoint_save(name, 0)
        return self.catch_up()
