"""The event log: open, write, scan, list, subscribe."""

from __future__ import annotations

import os
import queue
import shutil
import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from evlog import envelope, hatch, retention, trace, transfer
from evlog.errors import EvlogError, StorageError, Validation
from evlog.functions.json_meta import check_key, index_columns, index_key, index_values
from evlog.functions.prefix import stream_prefix_bound
from evlog.operators.filters import Filter
from evlog.operators.upcast import Upcaster, apply_chain, apply_frames
from evlog.plans import coordinates
from evlog.schema import CHECKPOINTS_SCHEMA, COLUMNS, I64_MAX, LEDGER_SCHEMA, LOG_SCHEMA, RECEIPTS_SCHEMA, STREAMS_SCHEMA, check_u63
from evlog.store.manifest import ROW_GROUP, Manifest, Segment, State, retrying
from evlog.store.reader import Reader
from evlog.txn import Committed, Transaction

PAGE = 256
#: Attempts of a bulk append to number its rows without the writer lock.
OPTIMISTIC = 2
#: Scans of at most so many stored rows are done on the driver, without a Spark job.
DRIVER_ROWS = 100_000


@dataclass(frozen=True)
class OpenOptions:
    upcasters: Sequence[Upcaster] = ()
    busy_ms: int = 5000
    poll_ms: int = 100
    unique_meta: tuple[str, ...] = ()


@dataclass(frozen=True)
class Recorded:
    """An event of a cross-stream read, in its current shape."""

    position: int
    stream: str
    event: dict[str, Any]

    @property
    def kind(self) -> str:
        return self.event["kind"]


class EventLog(hatch.QueryDoor, retention.Retention, transfer.Transfer):
    def __init__(self, spark: SparkSession, root: str, options: OpenOptions):
        self.spark, self.options = spark, options
        self.upcasters = tuple(options.upcasters)
        self.manifest = Manifest(root, options.busy_ms)
        self.runners: set[str] = set()
        self._queue: queue.Queue = queue.Queue()
        self._worker: threading.Thread | None = None
        self._closed = False
        self._scratch: str | None = None

    # opening and closing

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: OpenOptions = OpenOptions()) -> EventLog:
        """Open or create the log in a directory that driver and executors share."""
        with trace.span("open"):
            log = cls(spark, os.path.realpath(path), options)
            log.manifest.create()
            log.manifest.refresh()
            return log

    @classmethod
    def open_in_memory(cls, spark: SparkSession, options: OpenOptions = OpenOptions()) -> EventLog:
        """A log of its own directory that goes when it is closed."""
        root = tempfile.mkdtemp(prefix="evlog-")
        log = cls.open(spark, root, options)
        log._scratch = root
        weakref.finalize(log, shutil.rmtree, root, True)
        return log

    def database(self) -> str:
        """Which log this is: equal for two handles on one directory."""
        return self.manifest.root

    def shutdown(self) -> None:
        """Finish detached appends and take no more. Again is no error."""
        if not self._closed:
            self._closed = True
            if self._worker is not None:
                self._queue.put(None)
                self._worker.join()

    def close(self) -> None:
        self.shutdown()
        if self._scratch:
            shutil.rmtree(self._scratch, ignore_errors=True)

    def __enter__(self) -> EventLog:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # writing

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """One commit at the end of the block, or nothing if it raises."""
        with self.manifest.writing() as state:
            txn = Transaction(self, state)
            yield txn
            txn.commit()

    def with_transaction(self, body: Callable[[Transaction], Any]) -> Any:
        with trace.span("append"), self.transaction() as txn:
            return body(txn)

    def stream(self, name: str) -> StreamHandle:
        return StreamHandle(self, name)

    stream_handle = stream

    def detach_append(self, stream: str, event: dict[str, Any]) -> None:
        """Validated now, written in order by a worker; nobody is told how it went."""
        envelope.validate(event)
        if self._closed:
            raise StorageError("the log is closed")
        if self._worker is None:
            self._worker = threading.Thread(target=self._drain, daemon=True)
            self._worker.start()
        self._queue.put((stream, event))

    def _drain(self) -> None:
        while (item := self._queue.get()) is not None:
            try:
                retrying(lambda item=item: self.with_transaction(lambda t: t.append(*item)))
            except EvlogError:
                trace.LOGGER.warning("evlog.append detached write failed", extra={"span": "evlog.append", "fields": {"stream": item[0]}})

    def index_keys(self, state: State) -> list[str]:
        """Keys that new segments get columns for."""
        return [*state.meta_keys, *(k for k in self.options.unique_meta if k not in state.meta_keys)]

    def _check_unique(self, state: State, rows: list[dict[str, Any]]) -> None:
        """Against the key's own column where a segment has it: nothing else of the segment is read."""
        for key in self.options.unique_meta:
            new = [v for r in rows if (v := envelope.from_row(r)["meta"].get(key)) is not None]
            text, number = index_columns(key)
            strings, numbers = {v for v in new if isinstance(v, str)}, {float(v) for v in new if not isinstance(v, str)}
            if len(new) != len(strings) + len(numbers):
                raise Validation(f"meta.{key} repeats in the batch")
            if not new:
                continue
            own = [s for s in state.segments.values() if s.keys and key in s.keys]
            want = ds.field(text).isin(pa.array(sorted(strings), pa.string())) | ds.field(number).isin(pa.array(sorted(numbers), pa.float64()))
            if own and ds.dataset([self.manifest.check(s) for s in own], format="parquet").scanner(columns=[text], filter=want).head(1).num_rows:
                raise Validation(f"meta.{key} is in the log already")
            rest = [self.manifest.check(s) for s in state.segments.values() if not (s.keys and key in s.keys)]
            if rest:
                old = self.spark.read.schema(LOG_SCHEMA).parquet(*rest).select(*[c.alias(n) for n, c in index_values(F.col("meta"), key).items()])
                if old.where(F.col(text).isin(sorted(strings)) | F.col(number).isin(sorted(numbers))).limit(1).count():
                    raise Validation(f"meta.{key} is in the log already")

    def append_frame(self, df: DataFrame, order: Sequence[str]) -> tuple[int, int | None, int | None]:
        """Bulk append of (stream, epoch_ms, kind, schema_version, meta, data) rows in the given order: (rows, first, last position).

        The Spark jobs run without the writer lock; it is taken to publish, if nobody wrote in between.
        After ``OPTIMISTIC`` attempts the rows are numbered under the lock.
        """
        n, first, last, _ = self._append_frame(df, order, None)
        return n, first, last

    def _append_frame(self, df: DataFrame, order: Sequence[str], witness: Column | None) -> tuple[int, int | None, int | None, bool]:
        m = self.manifest
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        body = df.withColumns({"meta": F.coalesce("meta", F.lit("{}")), "data": F.coalesce("data", F.lit("{}")), "schema_version": F.coalesce("schema_version", F.lit(envelope.DEFAULT_VERSION)).cast("bigint")})
        bad = F.col("stream").isNull() | (F.col("stream") == "") | F.col("kind").isNull() | (F.col("kind") == "") | F.col("epoch_ms").isNull() | (F.col("epoch_ms") < 0)
        for c in ("meta", "data"):
            bad = bad | F.coalesce(~F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(True))
        stage = m.path("tmp", uuid.uuid4().hex)
        with trace.span("append"):
            try:
                coordinates.ordered(body.withColumn("_bad", bad), order, parts).write.parquet(stage)
                staged = self.spark.read.parquet(stage)
                n, wrong = staged.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_bad").cast("int")), F.lit(0))).first()
                if wrong:
                    raise Validation(f"{wrong} rows are no events")
                if not n:
                    return 0, None, None, True
                for attempt in range(OPTIMISTIC + 1):
                    held = m.writing() if attempt == OPTIMISTIC else nullcontext(m.refresh())
                    with held as state:
                        commit, same = self._numbered(staged, state, n, parts, witness)
                        with m.writing() as now:
                            if now.n == state.n:
                                m.publish(commit)
                                return n, state.next_position, state.next_position + n - 1, same
            finally:
                shutil.rmtree(stage, ignore_errors=True)
        raise StorageError("the rows could not be published")

    def _numbered(self, staged: DataFrame, state: State, n: int, parts: int, witness: Column | None) -> tuple[dict[str, Any], bool]:
        """The commit that appends the staged rows to this state, and whether all landed on the coordinates they came with."""
        m, keys = self.manifest, self.index_keys(state)
        out = coordinates.assign(staged, state.next_position - 1, self._counters(state))
        name, counted = f"segments/{uuid.uuid4().hex}", f"counters/{uuid.uuid4().hex}"
        came = {} if witness is None else {"_same": witness}
        more = {c: v for k in keys for c, v in index_values(F.col("meta"), k).items()}
        out = out.withColumns(more | came).select(*[F.col(c).cast(LOG_SCHEMA[c].dataType) for c in COLUMNS], *more, *came)
        out.repartitionByRange(parts, "position").sortWithinPartitions("position").write.option("parquet.block.size", ROW_GROUP).parquet(m.path(name))
        written = self.spark.read.parquet(m.path(name))
        written.groupBy("stream").agg((F.max("seq") + 1).alias("next_seq")).write.parquet(m.path(counted))
        add = m.described(self.spark, name, keys)
        touched = {}
        if state.stream_seq:  # streams that were written one by one
            known = self.spark.createDataFrame([(s,) for s in state.stream_seq], "stream string")
            touched = {r.stream: r.next_seq for r in self.spark.read.parquet(m.path(counted)).join(known, "stream", "left_semi").collect()}
        same = True if witness is None else bool(written.agg(F.coalesce(F.bool_and("_same"), F.lit(True))).first()[0])
        return {"add": add, "next_position": state.next_position + n, "counters": [*state.counters, counted], "stream_seq": touched}, same

    def _counters(self, state: State) -> DataFrame | None:
        frames = [self.spark.read.parquet(self.manifest.path(p)) for p in state.counters]
        if state.stream_seq:
            frames.append(self.spark.createDataFrame(list(state.stream_seq.items()), "stream string, next_seq bigint"))
        if not frames:
            return None
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out.groupBy("stream").agg(F.max("next_seq").alias("next_seq"))

    # scanning

    def _segments(self, state: State, above: int = 0, streams: frozenset[str] | None = None, kinds: frozenset[str] | None = None) -> list[Segment]:
        """Segments that can hold what is asked for, by their position range and names, in order."""
        return [
            s
            for s in sorted(state.segments.values(), key=lambda s: s.min_position)
            if s.max_position > above and (streams is None or s.streams is None or streams.intersection(s.streams)) and (kinds is None or s.kinds is None or kinds.intersection(s.kinds))
        ]

    def _frame(self, state: State, above: int = 0, f: Filter = Filter()) -> DataFrame:
        """The candidate segments' rows. A filter on an indexed key reaches the scan of the segments that have its column."""
        segments = self._segments(state, above, f.streams_, f.kinds_)
        key = next((k for k, _ in f.meta_ if k in state.meta_keys), None)
        own = [s for s in segments if key is not None and s.keys and key in s.keys]
        rest = [s for s in segments if s not in own] if own else segments
        frames = []
        if own:
            column, value = index_key(key, dict(f.meta_)[key])
            schema = StructType([*LOG_SCHEMA.fields, StructField(column, StringType() if isinstance(value, str) else DoubleType())])
            frames.append(self.spark.read.schema(schema).parquet(*map(self.manifest.check, own)).where(F.col(column) == value).select(*COLUMNS))
        if rest:
            frames.append(self.spark.read.schema(LOG_SCHEMA).parquet(*map(self.manifest.check, rest)))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], LOG_SCHEMA)

    def stored(self, from_: int = 0, f: Filter = Filter(), state: State | None = None) -> DataFrame:
        """Stored rows after a position, unordered, before upcasting."""
        check_u63(from_, "position")
        state = state or self.manifest.refresh()
        if f.selects_nothing:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self._frame(state, from_, f).where(F.col("position") > from_).where(f.column())

    def scan(self, from_: int = 0, f: Filter = Filter(), limit: int | None = None) -> DataFrame:
        """Rows after a position in their current shape, by position if limited."""
        df = self.stored(from_, f)
        if limit is not None:
            df = df.orderBy("position").limit(limit)
        return apply_frames(self.upcasters, df)

    def _rows(self, state: State, from_: int, f: Filter, limit: int | None, from_seq: int = 0, last: bool = False) -> list[dict[str, Any]]:
        """Stored rows in order, the first ``limit`` or the last; small reads stay on the driver.

        A limited read opens segments from its end of the log on until it has enough. One that skips many rows is finished by a Spark job.
        """
        if limit == 0 or f.selects_nothing:
            return []
        f.validate()
        check_u63(from_, "position")
        segments = self._segments(state, from_, f.streams_, f.kinds_)
        large = sum(s.rows for s in segments) > DRIVER_ROWS
        if limit is not None and not last:
            reader = self._reader(state, from_, f, from_seq, DRIVER_ROWS if large and not f.whole else None)
            rows = list(islice(reader, limit))
            if len(rows) == limit or reader.whole:
                return rows
            return rows + self._collected(state, rows[-1]["position"] if rows else from_, f, limit - len(rows), from_seq, False)
        if large and (limit is None or not f.whole):
            return self._collected(state, from_, f, limit, from_seq, last)
        want = ds.field("position") > from_
        if (more := _condition(f, from_seq)) is not None:
            want &= more
        out: list[dict[str, Any]] = []
        for group in _groups(sorted(segments, key=lambda s: -s.max_position) if last else segments, None if limit is None else 4 * limit + 1024):
            found = ds.dataset([self.manifest.check(s) for s in group], format="parquet").to_table(columns=COLUMNS, filter=want).sort_by("position")
            if limit is not None and not f.meta_:
                found = found.slice(max(0, len(found) - (limit - len(out))))
            columns = [found.column(c).to_pylist() for c in COLUMNS]
            rows = [dict(zip(COLUMNS, values, strict=True)) for values in zip(*columns, strict=True)]
            if f.meta_:
                rows = [r for r in rows if f.matches(r["stream"], r["kind"], envelope.from_row(r)["meta"])]
            out = rows + out if last else out + rows
            if limit is not None and len(out) >= limit:
                return out[-limit:]
        return out

    def _collected(self, state: State, from_: int, f: Filter, limit: int | None, from_seq: int, last: bool) -> list[dict[str, Any]]:
        """The same rows by a Spark job."""
        df = self.stored(from_, f, state)
        df = (df.where(F.col("seq") >= from_seq) if from_seq else df).orderBy(F.desc("position") if last else "position")
        rows = [r.asDict() for r in (df.limit(limit) if limit is not None else df).collect()]
        return rows[::-1] if last else rows

    def _reader(self, state: State, from_: int, f: Filter, from_seq: int = 0, most: int | None = None) -> Reader:
        """Stored rows in order, as they are asked for."""
        test = (lambda r: f.matches(r["stream"], r["kind"], envelope.from_row(r)["meta"])) if f.meta_ else None
        return Reader(self._segments(state, from_, f.streams_, f.kinds_), self.manifest.check, from_, _condition(f, from_seq), test, most)

    def _recorded(self, rows: list[dict[str, Any]]) -> list[Recorded]:
        return [Recorded(r["position"], r["stream"], apply_chain(self.upcasters, e)) for r, e in zip(rows, envelope.from_rows(rows), strict=True)]

    def read_all(self, from_: int = 0, f: Filter = Filter(), limit: int | None = None) -> list[Recorded]:
        """Events after a position (exclusive), in order, filtered as stored, in their current shape."""
        return self._recorded(self._rows(self.manifest.refresh(), from_, f, limit))

    def _read_stream(self, state: State, stream: str, f: Filter, from_seq: int, limit: int | None, last: bool = False) -> list[dict[str, Any]]:
        if limit == 0 or f.selects_nothing:
            return []
        check_u63(from_seq, "seq")
        rows = self._rows(state, 0, f.stream(stream), limit, from_seq, last)
        return [apply_chain(self.upcasters, e) for e in envelope.from_rows(rows)]

    def _stream_head(self, state: State, stream: str) -> int | None:
        """The stream's greatest stored number: its counter's last, unless something was removed."""
        if not state.retention:
            return self.manifest.next_seq(state, stream) - 1 or None
        rows = self._rows(state, 0, Filter().stream(stream), 1, last=True)
        return rows[0]["seq"] if rows else None

    def _stream_len(self, state: State, stream: str) -> int:
        if not state.retention:
            return self.manifest.next_seq(state, stream) - 1
        segments = self._segments(state, 0, frozenset([stream]))
        if sum(s.rows for s in segments) > DRIVER_ROWS:
            return self._frame(state, 0, Filter().stream(stream)).where(F.col("stream") == stream).count()
        return ds.dataset([self.manifest.check(s) for s in segments], format="parquet").count_rows(filter=ds.field("stream") == stream) if segments else 0

    def head_position(self) -> int:
        """The greatest stored position; 0 for an empty log. It falls when retention empties the tail."""
        return self.manifest.refresh().head

    def replay(self, from_: int = 0, f: Filter = Filter(), page: int = PAGE) -> Iterator[Recorded]:
        """Everything after a position, in pages, ending at the first short one.

        The files are read on from page to page; after a commit they are opened again, in the new state.
        """
        pages = _Pages(self, f)
        while True:
            rows = pages.read(from_, page)
            yield from self._recorded(rows)
            if len(rows) < page:
                return
            from_ = rows[-1]["position"]

    def subscribe(self, from_: int = 0, f: Filter = Filter(), page: int = PAGE, stop: threading.Event | None = None) -> Iterator[Recorded]:
        """As ``replay``, then waiting for more, until ``stop`` is set."""
        pages = _Pages(self, f)
        while stop is None or not stop.is_set():
            with self.manifest.wake:
                n = self.manifest.state.n
            head = self.head_position()  # before the page: what is passed over was there to be read
            got = self._recorded(pages.read(from_, page))
            yield from got
            if len(got) == page:
                from_ = got[-1].position
                continue
            from_ = max([from_, head, *(r.position for r in got[-1:])])
            with self.manifest.wake:
                if self.manifest.state.n == n:
                    self.manifest.wake.wait(self.options.poll_ms / 1000)

    # consumers

    def checkpoint_load(self, consumer: str) -> int:
        return self.manifest.refresh().checkpoints.get(consumer, [0])[0]

    def checkpoint_save(self, consumer: str, position: int) -> None:
        check_u63(position, "position")
        retrying(lambda: self.with_transaction(lambda t: t.checkpoint_save(consumer, position)))

    def index_meta(self, key: str) -> None:
        """Give a key columns of its own in all segments from here on, and in the others at the next ``reclaim``. Again is no error.

        A filter on the key then prunes row groups by them; what it finds stays the same.
        """
        check_key(key)
        with trace.span("index"), self.manifest.writing() as state:
            if key not in state.meta_keys:
                self.manifest.publish({"meta_keys": [key]})

    # listings: exclusive cursors, ordered, bounded

    def streams(self, after: str | None = None, prefix: str | None = None, limit: int | None = None) -> DataFrame:
        """(stream, head_seq) by name; emptied streams still list."""
        if limit == 0:
            return self.spark.createDataFrame([], STREAMS_SCHEMA)
        out = self._streams(self.manifest.refresh())
        if after is not None:
            out = out.where(F.col("stream") > after)
        if prefix:
            out = out.where(F.col("stream") >= prefix)
            if (bound := stream_prefix_bound(prefix)) is not None:
                out = out.where(F.col("stream") < bound)
        out = out.orderBy("stream")
        return out if limit is None else out.limit(limit)

    def _streams(self, state: State) -> DataFrame:
        own = self._counters(state)
        return self.spark.createDataFrame([], STREAMS_SCHEMA) if own is None else own.select("stream", F.greatest(F.col("next_seq") - 1, F.lit(0)).alias("head_seq"))

    def kinds(self, after: str | None = None, limit: int | None = None) -> DataFrame:
        """Kinds that are still stored, by name."""
        out = self._frame(self.manifest.refresh()).select("kind").distinct()
        if after is not None:
            out = out.where(F.col("kind") > after)
        out = out.orderBy("kind")
        return out if limit is None else out.limit(limit)

    def _listing(self, rows: list[tuple], schema, after, limit) -> DataFrame:
        rows = sorted(r for r in rows if after is None or r[0] > after)
        return self.spark.createDataFrame(rows[:limit] if limit is not None else rows, schema)

    def checkpoints(self, after: str | None = None, limit: int | None = None) -> DataFrame:
        return self._listing([(k, *v) for k, v in self.manifest.refresh().checkpoints.items()], CHECKPOINTS_SCHEMA, after, limit)

    def retention_ledger(self, after: int | None = None, limit: int | None = None) -> DataFrame:
        after = None if after is None else min(after, I64_MAX)
        return self._listing([tuple(r[k] for k in LEDGER_SCHEMA.fieldNames()) for r in self.manifest.refresh().retention], LEDGER_SCHEMA, after, limit)

    def export_receipts(self, after: int | None = None, limit: int | None = None) -> DataFrame:
        after = None if after is None else min(after, I64_MAX)
        return self._listing([tuple(r[k] for k in RECEIPTS_SCHEMA.fieldNames()) for r in self.manifest.refresh().exports.values()], RECEIPTS_SCHEMA, after, limit)


def _condition(f: Filter, from_seq: int = 0) -> pc.Expression | None:
    """What a filter asks of stored columns, and a least sequence number; meta is asked of rows."""
    parts = [ds.field("seq") >= from_seq] if from_seq else []
    if f.kinds_ is not None:
        parts.append(ds.field("kind").isin(sorted(f.kinds_)))
    if f.streams_ is not None:
        parts.append(ds.field("stream").isin(sorted(f.streams_)))
    if f.prefix_:
        parts.append(pc.starts_with(ds.field("stream"), f.prefix_))
    return reduce(lambda a, b: a & b, parts) if parts else None


class _Pages:
    """Pages of a scan: each in the newest state, read on where the one before ended if nothing was committed in between."""

    def __init__(self, log: EventLog, f: Filter):
        self.log, self.f, self.at, self.rows = log, f, (-1, -1), iter(())

    def read(self, from_: int, size: int) -> list[dict[str, Any]]:
        if size == 0 or self.f.selects_nothing:
            return []
        state = self.log.manifest.refresh()
        if self.at != (state.n, from_):
            self.f.validate()
            self.rows = iter(self.log._reader(state, check_u63(from_, "position"), self.f))
        out = list(islice(self.rows, size))
        self.at = (state.n, out[-1]["position"] if out else from_)
        return out


def _groups(segments: list[Segment], rows: int | None) -> Iterator[list[Segment]]:
    """Runs of segments that have about so many rows, doubling; all at once without a number. A run never parts overlapping ranges."""
    if rows is None:
        if segments:
            yield segments
        return
    held: list[Segment] = []
    n = low = high = 0
    for s in segments:
        if held and n >= rows and (s.min_position > high or s.max_position < low):
            yield held
            held, n, rows = [], 0, 2 * rows
        low, high = (min(low, s.min_position), max(high, s.max_position)) if held else (s.min_position, s.max_position)
        held.append(s)
        n += s.rows
    if held:
        yield held


class StreamHandle:
    """One stream of a log."""

    def __init__(self, log: EventLog, name: str):
        if not isinstance(name, str) or not name:
            raise Validation("a stream has a non-empty name")
        self.log, self.name = log, name

    def _write(self, body: Callable[[Transaction], Any]) -> Any:
        return retrying(lambda: self.log.with_transaction(body))

    def append(self, event: dict[str, Any]) -> Committed:
        return self._write(lambda t: t.append(self.name, event))

    def append_many(self, events: Iterable[dict[str, Any]]) -> list[Committed]:
        events = list(events)
        return self._write(lambda t: t.append_many(self.name, events))

    def append_at(self, epoch_ms: int, event: dict[str, Any]) -> Committed:
        return self._write(lambda t: t.append_at(self.name, epoch_ms, event))

    def append_expecting(self, expected: int | None, event: dict[str, Any]) -> Committed:
        return self._write(lambda t: t.append_expecting(self.name, expected, event))

    def append_if(self, kinds: Iterable[str] | None, decide: Callable[[list[dict[str, Any]]], dict[str, Any] | None]) -> Committed | None:
        """Read, decide and append in one write; None writes nothing. A decision is made once: it isn't retried."""
        with trace.span("decide", stream=self.name), self.log.transaction() as t:
            event = decide(t.read(self.name, kinds))
            return None if event is None else t.append(self.name, event)

    def detach_append(self, event: dict[str, Any]) -> None:
        self.log.detach_append(self.name, event)

    def read_kinds(self, kinds: Iterable[str] | None, from_seq: int = 0, limit: int | None = None) -> list[dict[str, Any]]:
        """Events from a sequence number on (inclusive), in order."""
        f = Filter() if kinds is None else Filter.of_kinds(kinds)
        return self.log._read_stream(self.log.manifest.refresh(), self.name, f, from_seq, limit)

    def read(self, from_seq: int = 0, limit: int | None = None) -> list[dict[str, Any]]:
        return self.read_kinds(None, from_seq, limit)

    def read_last(self, n: int) -> list[dict[str, Any]]:
        """The last n, oldest first."""
        return self.log._read_stream(self.log.manifest.refresh(), self.name, Filter(), 0, n, True)

    def head(self) -> int | None:
        return self.log._stream_head(self.log.manifest.refresh(), self.name)

    def len(self) -> int:
        return self.log._stream_len(self.log.manifest.refresh(), self.name)

    def is_empty(self) -> bool:
        return self.head() is None

    def database(self) -> str:
        return self.log.database()

    def query(self, sql: str, params: Any = None) -> list[dict[str, Any]]:
        return self.log.query(sql, params)

    def query_timeout(self, sql: str, params: Any, seconds: float) -> list[dict[str, Any]]:
        return self.log.query_timeout(sql, params, seconds)
