"""The commit protocol: one transaction is one manifest commit.

``_log/<n>.json`` holds what commit n changes; it is published by an exclusive
link, so exactly one writer wins n, and readers see published commits only.
Every ``FOLD_EVERY`` commits the folded state is kept as ``_log/<n>.state.json``.
Bulk commits keep per-stream counters in Parquet (``counters``), not in the
state, which therefore doesn't grow with the number of streams they touch.

A commit costs what it changes: states share what it leaves alone, and small
segments are merged in tiers of ``FAN``, so that their number grows with the
logarithm of the events.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq

from evlog.errors import Busy, Corruption, StorageError, Validation
from evlog.functions.json_meta import indexed_table

FOLD_EVERY = 64
#: Segments of a tier that are merged; segments of this many rows and more are left alone.
FAN, TIER_ROWS = 32, 65_536
#: Streams or kinds of a segment that are listed by name.
NAMES = 64
RETRIES, BACKOFF_MS = 4, 5
#: Bytes of a row group that Spark writes: reads from a position on pass over those below it.
ROW_GROUP = 8 << 20


@dataclass
class Segment:
    path: str
    rows: int
    min_position: int
    max_position: int
    min_epoch: int
    max_epoch: int
    size: int
    streams: list[str] | None = None
    kinds: list[str] | None = None
    keys: list[str] | None = None

    @property
    def tier(self) -> int:
        return (self.rows.bit_length() - 1) // 5


@dataclass
class State:
    """Everything but the events, as of one commit."""

    n: int = 0
    segments: dict[str, Segment] = field(default_factory=dict)
    next_position: int = 1
    stream_seq: dict[str, int] = field(default_factory=dict)
    counters: list[str] = field(default_factory=list)
    checkpoints: dict[str, list[int]] = field(default_factory=dict)
    retention: list[dict[str, Any]] = field(default_factory=list)
    exports: dict[int, dict[str, Any]] = field(default_factory=dict)
    models: dict[str, str] = field(default_factory=dict)
    tables: dict[str, str] = field(default_factory=dict)
    meta_keys: list[str] = field(default_factory=list)

    def fork(self) -> State:
        """A state to apply commits to. ``stream_seq`` is shared: only the holder of the writer lock asks it."""
        new = replace(self, segments=dict(self.segments), checkpoints=dict(self.checkpoints), retention=list(self.retention), exports=dict(self.exports), models=dict(self.models), tables=dict(self.tables), meta_keys=list(self.meta_keys))
        new.small = dict(self.small)
        return new

    def __post_init__(self) -> None:
        self.small: dict[str, Segment] = {}

    def crowded(self) -> list[Segment]:
        """The segments of the lowest tier that has ``FAN``."""
        tiers: dict[int, list[Segment]] = {}
        for s in self.small.values():
            tiers.setdefault(s.tier, []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FAN), [])

    def apply(self, c: dict[str, Any]) -> None:
        for s in c.get("add", ()):
            self.segments[s["path"]] = seg = Segment(**s)
            if seg.rows < TIER_ROWS:
                self.small[seg.path] = seg
        for p in c.get("remove", ()):
            self.segments.pop(p, None)
            self.small.pop(p, None)
        self.next_position = c.get("next_position", self.next_position)
        if "counters" in c:
            self.counters = c["counters"]
        for s in c.get("forget_seq", ()):
            self.stream_seq.pop(s, None)
        self.stream_seq.update(c.get("stream_seq", {}))
        self.checkpoints.update(c.get("checkpoints", {}))
        self.retention += c.get("retention", ())
        for e in c.get("exports", ()):
            self.exports[e["id"]] = e
        for k, ms in c.get("landed", {}).items():
            self.exports[int(k)] = self.exports[int(k)] | {"landed_ms": ms}
        for name, to in (("models", self.models), ("tables", self.tables)):
            for k, v in c.get(name, {}).items():
                if v is None:
                    to.pop(k, None)
                else:
                    to[k] = v
        for k in c.get("meta_keys", ()):
            if k not in self.meta_keys:
                self.meta_keys.append(k)
        self.n = c["n"]

    def dump(self) -> dict[str, Any]:
        return asdict(self)

    @staticmethod
    def load(d: dict[str, Any]) -> State:
        s = State(**d)
        s.segments = {k: Segment(**v) for k, v in d["segments"].items()}
        s.exports = {int(k): v for k, v in d["exports"].items()}
        s.small = {k: x for k, x in s.segments.items() if x.rows < TIER_ROWS}
        return s

    @property
    def head(self) -> int:
        """The greatest position that is still stored (0: none)."""
        return max((s.max_position for s in self.segments.values()), default=0)

    @property
    def watermark(self) -> int:
        return max((r["highest_removed"] for r in self.retention), default=0)


class Manifest:
    def __init__(self, root: str, busy_ms: int = 5000):
        self.root, self.busy_ms = root, busy_ms
        self.mutex = threading.RLock()
        self.wake = threading.Condition()
        self.state = State()

    def path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def create(self) -> None:
        if os.path.isdir(self.root) and os.listdir(self.root) and not os.path.isdir(self.path("_log")):
            raise Validation(f"{self.root} holds something else")
        for d in ("_log", "segments", "models", "tables", "counters", "tmp"):
            os.makedirs(self.path(d), exist_ok=True)

    def _file(self, n: int, suffix: str = "json") -> str:
        return self.path("_log", f"{n:020d}.{suffix}")

    def refresh(self) -> State:
        """The newest published state."""
        with self.mutex:
            if self.state.n == 0 and os.path.isdir(self.path("_log")):
                folded = sorted(f for f in os.listdir(self.path("_log")) if f.endswith(".state.json"))
                if folded:
                    self.state = State.load(json.load(open(self.path("_log", folded[-1]), encoding="utf-8")))
            changed = False
            while os.path.exists(self._file(self.state.n + 1)):
                try:
                    with open(self._file(self.state.n + 1), encoding="utf-8") as f:
                        commit = json.load(f)
                except ValueError as e:
                    raise Corruption(f"commit {self.state.n + 1} can't be read") from e
                fresh = self.state if changed else self.state.fork()
                fresh.apply(commit)
                self.state, changed = fresh, True
            return self.state

    @contextlib.contextmanager
    def writing(self) -> Iterator[State]:
        """The writer lock, across threads and processes, with the newest state."""
        with self.mutex_within(self.busy_ms), open(self.path(".lock"), "a+b") as f:
            until = time.monotonic() + self.busy_ms / 1000
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except OSError:
                    if time.monotonic() >= until:
                        raise Busy("another writer holds the log") from None
                    time.sleep(0.002)
            try:
                yield self.refresh()
            finally:
                fcntl.flock(f, fcntl.LOCK_UN)

    @contextlib.contextmanager
    def mutex_within(self, ms: int) -> Iterator[None]:
        if not self.mutex.acquire(timeout=ms / 1000):
            raise Busy("another writer holds the log")
        try:
            yield
        finally:
            self.mutex.release()

    def publish(self, commit: dict[str, Any]) -> State:
        """Publish under the lock. Nothing is visible before, everything is after."""
        n = self.state.n + 1
        commit = {k: v for k, v in commit.items() if v} | {"n": n}
        tmp = self.path("tmp", uuid.uuid4().hex)
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(commit, f, ensure_ascii=False)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(tmp, self._file(n))
        except FileExistsError:
            raise Busy("another writer published first") from None
        except OSError as e:
            raise StorageError(str(e)) from e
        finally:
            os.unlink(tmp)
        state = self.refresh()
        if n % FOLD_EVERY == 0:
            tmp = self.path("tmp", uuid.uuid4().hex)
            with open(tmp, "w", encoding="utf-8") as f:
                json.dump(state.dump(), f, ensure_ascii=False)
            os.replace(tmp, self._file(n, "state.json"))
        with self.wake:
            self.wake.notify_all()
        return state

    def next_seq(self, state: State, stream: str) -> int:
        """The stream's next sequence number: never rewinds, whatever was removed."""
        if stream in state.stream_seq:
            return state.stream_seq[stream]
        if not state.counters:
            return 1
        files = [self.path(p, f) for p in state.counters for f in os.listdir(self.path(p)) if f.endswith(".parquet")]
        found = ds.dataset(files, format="parquet").to_table(filter=ds.field("stream") == stream, columns=["next_seq"]) if files else None
        return max(found.column("next_seq").to_pylist(), default=1) if found is not None else 1

    def write_segment(self, table: pa.Table, keys: list[str]) -> dict[str, Any]:
        """A small segment, written on the driver: temporary name, fsync, rename, read-only."""
        name = f"segments/{uuid.uuid4().hex}.parquet"
        for k in keys:
            table = indexed_table(table, k)
        tmp = self.path("tmp", uuid.uuid4().hex)
        pq.write_table(table, tmp)
        with open(tmp, "rb") as f:
            os.fsync(f.fileno())
        os.chmod(tmp, 0o444)
        os.rename(tmp, self.path(name))
        streams, kinds = (table.column(c).unique().to_pylist() for c in ("stream", "kind"))
        return self.describe(name, streams if len(streams) <= NAMES else None, kinds if len(kinds) <= NAMES else None, keys)

    def merge(self, segments: list[Segment], schema: pa.Schema, keys: list[str]) -> dict[str, Any]:
        """A tier of small segments as one."""
        whole = ds.dataset([self.check(s) for s in segments], format="parquet").to_table(columns=schema.names)
        return self.write_segment(whole.cast(schema).sort_by("position"), keys)

    def describe(self, name: str, streams: list[str] | None = None, kinds: list[str] | None = None, keys: list[str] | None = None) -> dict[str, Any]:
        full = self.path(name)
        meta = pq.ParquetFile(full).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}

        def reach(column: str) -> tuple[int, int]:
            stats = [meta.row_group(g).column(at[column]).statistics for g in range(meta.num_row_groups)]
            return min(s.min for s in stats), max(s.max for s in stats)

        (p0, p1), (e0, e1) = reach("position"), reach("epoch_ms")
        return asdict(Segment(name, meta.num_rows, p0, p1, e0, e1, os.path.getsize(full), sorted(streams) if streams is not None else None, sorted(kinds) if kinds is not None else None, keys or None))

    def described(self, spark, name: str, keys: list[str]) -> list[dict[str, Any]]:
        """The files that Spark wrote to a folder, with the names of streams and kinds of those that have few."""
        from pyspark.sql import functions as F

        at = spark.read.parquet(self.path(name)).select(F.col("_metadata.file_name").alias("file"), "stream", "kind")
        few = at.groupBy("file").agg(F.countDistinct("stream").alias("s"), F.countDistinct("kind").alias("k")).where(f"s <= {NAMES} or k <= {NAMES}")
        found: dict[str, dict[str, list[str]]] = {}
        for c, n in (("stream", "s"), ("kind", "k")):
            for r in at.join(few.where(f"{n} <= {NAMES}").select("file"), "file", "left_semi").groupBy("file").agg(F.collect_set(c).alias("v")).collect():
                found.setdefault(r.file, {})[c] = r.v
        files = sorted(f for f in os.listdir(self.path(name)) if f.endswith(".parquet"))
        files = [f for f in files if pq.ParquetFile(self.path(name, f)).metadata.num_rows]
        return [self.describe(f"{name}/{f}", found.get(f, {}).get("stream"), found.get(f, {}).get("kind"), keys) for f in files]

    def check(self, s: Segment) -> str:
        full = self.path(s.path)
        try:
            size = os.path.getsize(full)
        except OSError as e:
            raise Corruption(f"segment {s.path} is missing") from e
        if size != s.size:
            raise Corruption(f"segment {s.path} has {size} bytes, {s.size} were written")
        return full


def retrying(write):
    """Run a write again while the log is busy: 4 times, after 10, 20, 40 and 80 ms."""
    for attempt in range(1, RETRIES + 1):
        try:
            return write()
        except Busy:
            time.sleep(BACKOFF_MS * 2**attempt / 1000)
    return write()
