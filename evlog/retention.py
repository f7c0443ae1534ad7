"""Guarded removal: plans, guards, the ledger, recorded exports and archiving."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from evlog import envelope, trace
from evlog.errors import ConsumerBehind, NotExported, Truncated, Validation
from evlog.operators.filters import Filter
from evlog.functions.json_meta import index_values
from evlog.schema import LOG_SCHEMA, check_u63
from evlog.store.manifest import ROW_GROUP, Segment, State
from evlog.transfer import ExportedEvent, FrameSink, Sink, records


#: Stored bytes and rows that a task of a rewrite sorts, about; above the rows from which ``reclaim`` leaves a segment alone.
SLICE_BYTES, SLICE_ROWS = 128 << 20, 1_500_000


@dataclass(frozen=True)
class Plan:
    """What to remove: everything up to a position, older than a time, or of some streams."""

    what: str
    value: Any

    @staticmethod
    def before(position: int) -> Plan:
        return Plan("before", check_u63(position, "position"))

    @staticmethod
    def older_than(epoch_ms: int) -> Plan:
        return Plan("older_than", check_u63(epoch_ms, "epoch_ms"))

    @staticmethod
    def streams(names: Iterable[str]) -> Plan:
        return Plan("streams", tuple(sorted(set(names))))

    def column(self) -> Column:
        if self.what == "before":
            return F.col("position") <= self.value
        if self.what == "older_than":
            return F.col("epoch_ms") < self.value
        return F.col("stream").isin(list(self.value)) if self.value else F.lit(False)

    def may_touch(self, s: Segment) -> bool:
        if self.what == "before":
            return s.min_position <= self.value
        if self.what == "older_than":
            return s.min_epoch < self.value
        return bool(self.value) and (s.streams is None or bool(set(self.value).intersection(s.streams)))

    def covers(self, s: Segment) -> bool:
        """Whether the whole segment goes, by its figures alone."""
        if self.what == "before":
            return s.max_position <= self.value
        if self.what == "older_than":
            return s.max_epoch < self.value
        return s.streams is not None and set(s.streams) <= set(self.value)

    def describe(self) -> str:
        return f"{self.what}:{len(self.value) if self.what == 'streams' else self.value}"


class Guard(Enum):
    REGISTERED_CONSUMERS = "registered"
    FORCE = "force"
    EXPORTED = "exported"


@dataclass(frozen=True)
class Report:
    removed: int = 0
    highest_removed: int | None = None
    streams_affected: int = 0


@dataclass(frozen=True)
class Receipt:
    id: int
    from_position: int
    through: int
    count: int
    whole: bool


@dataclass(frozen=True)
class Completeness:
    """Whether history from a cursor on is all there; if not, up to where some was removed."""

    removed_up_to: int | None

    @property
    def complete(self) -> bool:
        return self.removed_up_to is None


def chain_reach(intervals: Iterable[tuple[int, int]]) -> int:
    """How far intervals (from, through) reach from 0 without a gap."""
    reach = 0
    for start, through in sorted(intervals):
        if start > reach:
            break
        reach = max(reach, through)
    return reach


class Retention:
    """Part of ``EventLog``."""

    def removed_watermark(self) -> int:
        return self.manifest.refresh().watermark

    def completeness_from(self, from_: int) -> Completeness:
        mark = self.removed_watermark()
        return Completeness(mark if check_u63(from_, "position") < mark else None)

    def require_complete_from(self, from_: int, state: State | None = None) -> None:
        mark = (state or self.manifest.refresh()).watermark
        if from_ < mark:
            raise Truncated(from_, mark)

    def exported_through(self) -> int:
        return self._reach(self.manifest.refresh())

    @staticmethod
    def _reach(state: State) -> int:
        return chain_reach((e["from_position"], e["through"]) for e in state.exports.values() if e["whole"] and e["landed_ms"] is not None)

    def _tally(self, state: State, plan: Plan) -> tuple[int, int | None, int]:
        paths = [self.manifest.check(s) for s in state.segments.values() if plan.may_touch(s)]
        if not paths:
            return 0, None, 0
        r = self.spark.read.parquet(*paths).where(plan.column()).agg(F.count(F.lit(1)), F.max("position"), F.countDistinct("stream")).first()
        return r[0], r[1], r[2]

    def retain(self, plan: Plan, guard: Guard = Guard.REGISTERED_CONSUMERS, label: str = "") -> Report:
        """Remove what the plan matches, or nothing: count, guard, rewrite and ledger row are one commit."""
        with trace.span("retain", plan=plan.describe()) as seen, self.manifest.writing() as state:
            removed, highest, streams = self._tally(state, plan)
            if not removed:
                return Report()
            if guard is Guard.EXPORTED and highest > (reach := self._reach(state)):
                raise NotExported(highest, reach)
            if guard is not Guard.FORCE:
                behind = sorted((v[0], k) for k, v in state.checkpoints.items() if v[0] < highest)
                if behind:
                    raise ConsumerBehind(behind[0][1], behind[0][0], highest)
            touched = [s for s in state.segments.values() if plan.may_touch(s)]
            rest = [s for s in touched if not plan.covers(s)]  # segments that go as a whole aren't read
            row = {"id": len(state.retention) + 1, "applied_ms": envelope.now_ms(), "plan": label + plan.describe(), "removed_count": removed, "highest_removed": highest}
            self.manifest.publish({"add": self._rewrite(rest, ~plan.column(), self.index_keys(state)), "remove": [s.path for s in touched], "retention": [row]})
            seen["removed"] = removed
            return Report(removed, highest, streams)

    def _rewrite(self, segments: list[Segment], keep: Column | None, keys: list[str]) -> list[dict[str, Any]]:
        """What is kept of some segments, as new ones of the same positions, with columns for the indexed keys."""
        if not segments:
            return []
        name = f"segments/{uuid.uuid4().hex}"
        df = self.spark.read.schema(LOG_SCHEMA).parquet(*[self.manifest.check(s) for s in segments])
        if keep is not None:
            df = df.where(keep)
        parts = max(1, sum(s.size for s in segments) // SLICE_BYTES, sum(s.rows for s in segments) // SLICE_ROWS)
        df = df.repartitionByRange(parts, "position").sortWithinPartitions("position")
        df = df.withColumns({c: v for k in keys for c, v in index_values(F.col("meta"), k).items()})  # after the shuffle: its sample needs none of them
        df.write.option("parquet.block.size", ROW_GROUP).parquet(self.manifest.path(name))
        return self.manifest.described(self.spark, name, keys)

    def reclaim(self, small_rows: int = 1_000_000, grace: float = 60.0) -> int:
        """Merge small segments and counters, give indexed keys their columns everywhere, and delete files that no commit has named for ``grace`` seconds; how many files went.

        The grace is for readers that hold a plan over files of an earlier state.
        """
        with trace.span("reclaim"), self.manifest.writing() as state:
            keys = self.index_keys(state)
            small = [s for s in state.segments.values() if s.rows < small_rows]
            small = small if len(small) > 1 else []
            bare = [s for s in state.segments.values() if s not in small and set(keys) - set(s.keys or ())]
            commit: dict[str, Any] = {}
            if small or bare:
                commit |= {"add": self._rewrite([*small, *bare], None, keys), "remove": [s.path for s in (*small, *bare)]}
            if len(state.counters) > 8:
                merged = f"counters/{uuid.uuid4().hex}"
                self.spark.read.parquet(*map(self.manifest.path, state.counters)).groupBy("stream").agg(F.max("next_seq").alias("next_seq")).write.parquet(self.manifest.path(merged))
                commit["counters"] = [merged]
            if commit:
                state = self.manifest.publish(commit)
            old = time.time() - grace
            live = {s.path for s in state.segments.values()}
            gone = 0
            for top, _, files in os.walk(self.manifest.path("segments")):
                for f in files:
                    full = os.path.join(top, f)
                    if os.path.relpath(full, self.manifest.root) not in live and os.path.getctime(full) <= old:
                        os.unlink(full)
                        gone += f.endswith(".parquet")
            for d in ("models", "tables"):
                named = {x for p in getattr(state, d).values() if p for x in p.split("|")}
                for name in os.listdir(self.manifest.path(d)):
                    for version in os.listdir(self.manifest.path(d, name)):
                        if f"{d}/{name}/{version}" not in named and os.path.getctime(self.manifest.path(d, name, version)) <= old:
                            shutil.rmtree(self.manifest.path(d, name, version))
                            gone += 1
            for name in os.listdir(self.manifest.path("counters")):
                if f"counters/{name}" not in state.counters and os.path.getctime(self.manifest.path("counters", name)) <= old:
                    shutil.rmtree(self.manifest.path("counters", name))
            return gone

    def export_recorded(self, from_: int = 0, f: Filter = Filter(), limit: int | None = None) -> tuple[list[ExportedEvent], Receipt]:
        """A page and its receipt. Only confirmed receipts of unfiltered pages count towards ``exported_through``."""
        with trace.span("export") as seen:
            page = self.export(from_, f, limit)
            receipt = self._receipt(from_, page[-1].position if page else from_, len(page), f.whole)
            seen["count"] = len(page)
            return page, receipt

    def _receipt(self, from_: int, through: int, count: int, whole: bool) -> Receipt:
        with self.manifest.writing() as state:
            receipt = Receipt(max(state.exports, default=0) + 1, from_, through, count, whole)
            self.manifest.publish({"exports": [receipt.__dict__ | {"taken_ms": envelope.now_ms(), "landed_ms": None}]})
            return receipt

    def confirm_export(self, receipt_id: int) -> None:
        """What the receipt covers is safe elsewhere. Again is no error."""
        with self.manifest.writing() as state:
            if receipt_id not in state.exports:
                raise Validation(f"there is no export {receipt_id}")
            if state.exports[receipt_id]["landed_ms"] is None:
                self.manifest.publish({"landed": {str(receipt_id): envelope.now_ms()}})

    def archive_then_retain(self, plan: Plan, sink: Sink, page: int = 256) -> Report:
        """Export from the end of the confirmed chain to the plan's highest position, page by page (a ``FrameSink`` gets one frame), then remove."""
        if page <= 0:
            raise Validation("a page holds one event at least")
        with trace.span("archive", plan=plan.describe()):
            highest = self._tally(self.manifest.refresh(), plan)[1]
            if highest is None:
                return Report()
            at = self.exported_through()
            if isinstance(sink, FrameSink) and at < highest:  # one page, whatever its size, written by Spark
                rows = self.stored(at).where(F.col("position") <= highest)
                receipt = self._receipt(at, highest, rows.count(), True)
                sink.write_frame(records(rows))
                self.confirm_export(receipt.id)
                at = highest
            while at < highest:
                got, receipt = self.export_recorded(at, Filter(), page)
                if not got:
                    break
                sink.write(got)
                self.confirm_export(receipt.id)
                at = receipt.through
            return self.retain(plan, Guard.EXPORTED, "archive-then-remove: ")
