"""The operators as queries over the driver's tables, each with its DuckDB SQL.

``events`` is loaded into a log of its own, once for a session and folder: a
stream for each user, positions in event order. Every query runs the engine on
that log (or on a backup of it, where it writes), never on the table itself.
``COVERS`` names the rows of the operator inventory that a query runs.
"""

from __future__ import annotations

import io
import json
import logging
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog import envelope, trace
from evlog.errors import Busy, ConsumerBehind, EvlogError, HeadMismatch, NotExported, StorageError, Truncated
from evlog.log import EventLog, OpenOptions
from evlog.memory import MemoryStream
from evlog.operators.filters import Filter
from evlog.operators.upcast import Upcaster
from evlog.plans.coordinates import shared_dir
from evlog.project import Projection, ProjectionRunner
from evlog.retention import Guard, Plan
from evlog.sources.jsonl import read_records
from evlog.store.manifest import retrying
from evlog.streaming.follow import follow
from evlog.transfer import ExportedEvent, FrameSink, JsonLinesSink, LogSink, Sink, read_json_lines

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}

_VIEW = """with log as (select event_id + 1 as position, 'user-' || user_id as stream,
  (row_number() over (partition by user_id order by event_id))::bigint as seq, epoch_us(ts) // 1000 as epoch_ms, event_type as kind,
  (case when event_type = 'purchase' then 2 else 1 end)::bigint as schema_version, props as meta,
  json_object('value', value)::varchar as data, value as v, event_id from events) """
_SHOWN = "position, stream, seq, epoch_ms, kind, schema_version, meta"
_STREAM = "seq, epoch_ms, kind, schema_version, meta"
_TYPES = {"position": "bigint", "stream": "string", "seq": "bigint", "epoch_ms": "bigint", "kind": "string", "schema_version": "bigint", "meta": "string"}
#: Rows that the driver holds before they are written.
KEPT = 65_536
_LOGS: dict[tuple[str, str], EventLog] = {}


def query(name: str, covers: str, sql: str, view: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], COVERS[name], SQL[name] = f, covers, (_VIEW if view else "") + sql
        return f

    return add


def new_root(spark: SparkSession) -> str:
    """A folder that the executors share, for a log of its own; the log protocol needs a file system there."""
    root = shared_dir(spark)
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    elif "://" in root:
        raise StorageError(f"a log needs a shared file system, not {root}")
    return f"{root.rstrip('/')}/evlog-logs-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        "event_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("stream"), F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch_ms"), F.col("event_type").alias("kind"),
        F.when(F.col("event_type") == "purchase", 2).otherwise(1).cast("bigint").alias("schema_version"), F.col("props").alias("meta"), F.to_json(F.struct("value")).alias("data"),
    )


def source_log(spark: SparkSession, d: str, options: OpenOptions | None = None) -> EventLog:
    """The log of a folder's events, for reading."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LOGS:
        log = EventLog.open(spark, new_root(spark))
        log.append_frame(event_rows(spark, d), ["event_id"])
        _LOGS[key] = log
    return _LOGS[key] if options is None else EventLog.open(spark, _LOGS[key].database(), options)


def own_log(spark: SparkSession, d: str, options: OpenOptions = OpenOptions()) -> EventLog:
    """A backup of it, to write to."""
    root = new_root(spark)
    source_log(spark, d).backup_to(root)
    return EventLog.open(spark, root, options)


def empty_log(spark: SparkSession) -> EventLog:
    return EventLog.open(spark, new_root(spark))


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*[c.strip() for c in _SHOWN.split(",")])


def _tuples(found: Iterable[Any], shown: str) -> Iterator[tuple]:
    """The shown columns of events (Recorded, ExportedEvent or plain)."""
    for r in found:
        e = r if isinstance(r, dict) else r.event
        whole = {"seq": e["seq"], "epoch_ms": e["epoch_ms"], "kind": e["kind"], "schema_version": e["_schema_version"], "meta": json.dumps(e["meta"])}
        if not isinstance(r, dict):
            whole |= {"position": r.position, "stream": r.stream}
        yield tuple(whole[c.strip()] for c in shown.split(","))


def _schema(shown: str) -> str:
    return ", ".join(f"{c.strip()} {_TYPES[c.strip()]}" for c in shown.split(","))


def _rows(spark: SparkSession, found: Iterable[Any], shown: str = _SHOWN) -> DataFrame:
    """Events that the driver holds as rows."""
    return spark.createDataFrame(list(_tuples(found, shown)), _schema(shown))


def _kept(spark: SparkSession, found: Iterable[Any], shown: str = _SHOWN) -> DataFrame:
    """The same for more events than the driver should hold: they go to a file in the shared folder, ``KEPT`` rows at once."""
    root, rows = new_root(spark), _tuples(found, shown)
    os.makedirs(root)
    names = [c.strip() for c in shown.split(",")]
    types = pa.schema([(c, {"bigint": pa.int64(), "string": pa.string()}[_TYPES[c]]) for c in names])
    with pq.ParquetWriter(os.path.join(root, "events.parquet"), types) as out:
        while part := list(islice(rows, KEPT)):
            out.write_table(pa.table([pa.array(v, t) for v, t in zip(zip(*part, strict=True), types.types, strict=True)], schema=types))
    return spark.read.schema(_schema(shown)).parquet(root)


def _refused(f: Callable[[], Any]) -> str:
    """The name of the error that a call ends with, or ``ok``."""
    try:
        f()
    except EvlogError as e:
        return type(e).__name__
    return "ok"


def _values(rows: list[tuple]) -> str:
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::bigint" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(show, r))})" for r in rows)


def ev(kind: str, data: dict[str, Any] | None = None, **meta: Any) -> dict[str, Any]:
    return {"kind": kind, "meta": meta, "data": data or {}}


# reading


@query("read_all_page", "S1 S2 O1 F11 J3", f"select {_SHOWN} from log where position > 500 order by position limit 256")
def _(spark, d):
    return _rows(spark, source_log(spark, d).read_all(500, limit=256))


@query("scan_page", "S1 S2 O1", f"select {_SHOWN} from log where position > 500 and kind <> 'view' order by position limit 300")
def _(spark, d):
    return _shown(source_log(spark, d).scan(500, Filter.of_kinds(["click", "error", "purchase", "signup"]), 300))


@query("read_stream_from_seq", "S3 S4 O2 S12", f"select {_STREAM} from log where stream = 'user-7' and seq >= 5 order by seq limit 20")
def _(spark, d):
    return _rows(spark, source_log(spark, d).stream("user-7").read(5, 20), _STREAM)


@query("read_stream_kinds", "S3 F3", f"select {_STREAM} from log where stream = 'user-7' and seq >= 5 and kind in ('click', 'purchase') order by seq limit 20")
def _(spark, d):
    return _rows(spark, source_log(spark, d).stream("user-7").read_kinds(["click", "purchase"], 5, 20), _STREAM)


@query("read_last_n", "S5 O3", f"select {_STREAM} from (select * from log where stream = 'user-7' order by seq desc limit 5) order by seq")
def _(spark, d):
    return _rows(spark, source_log(spark, d).stream("user-7").read_last(5), _STREAM)


@query("replay_pages", "S8 O4 O5", f"select {_SHOWN} from log where position > 300 and kind = 'click'")
def _(spark, d):
    return _kept(spark, source_log(spark, d).replay(300, Filter.of_kinds(["click"]), 64))


@query("subscribe_live", "S9 T1 T2", "select position, stream, kind from log where position > (select max(position) - 5 from log) union all select (select max(position) from log) + i, 'live', 'k' || i from range(1, 3) t(i)")
def _(spark, d):
    log, got = own_log(spark, d), []
    for r in log.subscribe(log.head_position() - 5, page=2):
        got.append((r.position, r.stream, r.kind))
        if len(got) in (5, 6):  # while the subscription is on
            log.stream("live").append(ev(f"k{len(got) - 4}"))
        if len(got) == 7:
            break
    return spark.createDataFrame(got, "position bigint, stream string, kind string")


@query("memory_stream", "S6", f"select * from (values {_values([(1, 'a', 1), (2, 'c', 1), (3, 'b', 7), (4, 'c', 1)])}) t(seq, kind, schema_version) where kind = 'c' or seq = 3", view=False)
def _(spark, d):
    s = MemoryStream()
    s.append_many([ev("a"), ev("c"), ev("b") | {"_schema_version": 7}])
    s.append_expecting(3, ev("c"))
    s.append_if(["a"], lambda seen: None if len(seen) == 1 else ev("never"))
    return spark.createDataFrame([(e["seq"], e["kind"], e["_schema_version"]) for e in s.read_kinds(["c"]) + s.read(3, 1)], "seq bigint, kind string, schema_version bigint")


@query("txn_reads_own_writes", "S7 W7 U11", "select seq, kind from log where stream = 'user-7' and seq > (select count(*) - 2 from log where stream = 'user-7') union all select (select count(*) from log where stream = 'user-7') + i, 'new' || i from range(1, 4) t(i)")
def _(spark, d):
    log = own_log(spark, d)
    with log.transaction() as t:
        t.append("user-7", ev("new1"))
        t.append_many("user-7", [ev("new2")])
        t.append_at("user-7", 5, ev("new3"))
        got = t.read("user-7", from_seq=t.head("user-7") - 4)
    return spark.createDataFrame([(e["seq"], e["kind"]) for e in got], "seq bigint, kind string")


@query("in_memory_log", "S10 S11 S15 S16", f"select * from (values {_values([('positions', 1, 3), ('closed', 0, 0), ('same', 1, 1)])}) t(what, a, b)", view=False)
def _(spark, d):
    with EventLog.open_in_memory(spark) as log:
        log.stream("a").append_many([ev("x"), ev("y"), ev("z")])
        ends = [r.position for r in log.read_all()]
        same = EventLog.open(spark, log.database()).database() == log.database()
        root = log.database()
    log.shutdown()  # again is no error
    return spark.createDataFrame([("positions", ends[0], ends[-1]), ("closed", int(os.path.exists(root)), 0), ("same", int(same), 1)], "what string, a bigint, b bigint")


@query("foreign_folder_refused", "S14", f"select * from (values {_values([('foreign', 'Validation'), ('empty', 'ok')])}) t(folder, outcome)", view=False)
def _(spark, d):
    full, bare = tempfile.mkdtemp(), tempfile.mkdtemp()
    open(os.path.join(full, "events"), "w").close()
    return spark.createDataFrame([("foreign", _refused(lambda: EventLog.open(spark, full))), ("empty", _refused(lambda: EventLog.open(spark, bare)))], "folder string, outcome string")


# filters


def _filtered(name: str, covers: str, f: Filter, where: str) -> None:
    @query(name, covers, f"select position, stream, kind, meta from log where {where}")
    def _(spark, d):
        return source_log(spark, d).scan(0, f).select("position", "stream", "kind", "meta")


_K = "json_extract(meta, '$.k')::bigint"
_filtered("filter_stream_set", "F1 F4 S2 O4", Filter().streams(["user-1", "user-2", "user-3"]), "stream in ('user-1', 'user-2', 'user-3')")
_filtered("filter_stream_prefix", "F5 F6", Filter().stream_prefix("user-1"), "starts_with(stream, 'user-1')")
_filtered("filter_set_and_prefix", "F4 F5", Filter().streams(["user-1", "user-22"]).stream_prefix("user-1"), "stream = 'user-1'")
_filtered("filter_kinds", "F2 F3", Filter.of_kinds(["signup", "error"]), "kind in ('signup', 'error')")
_filtered("filter_meta_number", "F7", Filter().meta("k", 69), f"{_K} = 69")
_filtered("filter_meta_type_strict", "F7", Filter().meta("k", "69"), "json_type(meta, '$.k') = 'VARCHAR' and json_extract_string(meta, '$.k') = '69'")
_filtered("filter_meta_bool", "F7", Filter().meta("k", True), f"json_type(meta, '$.k') in ('UBIGINT', 'BIGINT') and {_K} = 1")
_filtered("filter_nothing", "F9 O8", Filter.of_kinds([]), "false")


@query("filter_all_axes", "F1 F3 F5 F7", f"select {_SHOWN} from log where starts_with(stream, 'user-1') and kind in ('purchase', 'signup') and {_K} = 69")
def filter_all_axes(spark, d):
    return _shown(source_log(spark, d).scan(0, Filter().stream_prefix("user-1").kinds(["purchase", "signup"]).meta("k", 69)))


@query("filter_read_on_driver", "F1 F7 S1", f"select {_SHOWN} from log where kind = 'click' and {_K} between 7 and 8 and position > 100")
def _(spark, d):
    log = source_log(spark, d)
    return _rows(spark, [r for k in (7, 8) for r in log.read_all(100, Filter.of_kinds(["click"]).meta("k", k))])


_BAD_FILTERS = [("empty key", "Validation"), ("quote", "Validation"), ("null", "Validation"), ("list", "Validation"), ("members", "Validation"), ("apostrophe", "ok"), ("backslash", "ok"), ("limit 0", "ok")]


@query("filter_validation", "F8 O8", f"select * from (values {_values(_BAD_FILTERS)}) t(what, outcome)", view=False)
def _(spark, d):
    log = source_log(spark, d)
    tried = [Filter().meta("", 1), Filter().meta('a"b', 1), Filter().meta("k", None), Filter().meta("k", [1]), Filter().streams(map(str, range(40_000))), Filter().meta("it's", 1), Filter().meta("a\\b", 1)]
    out = [(what, _refused(lambda f=f: (log.scan(0, f).count(), log.read_all(0, f, 5)))) for (what, _), f in zip(_BAD_FILTERS, tried, strict=False)]
    return spark.createDataFrame([*out, ("limit 0", _refused(lambda: log.read_all(0, limit=0)))], "what string, outcome string")


@query("filter_odd_keys", "F7 F8", f"select * from (values {_values([('apostrophe', 1), ('backslash', 1), ('dot', 1), ('number', 2)])}) t(what, n)", view=False)
def _(spark, d):
    log = empty_log(spark)
    log.stream("s").append_many([{"kind": "x", "meta": {"it's": "a", "a\\b": "b", "a.b": True, "n": 40}, "data": {}}, {"kind": "x", "meta": {"n": 40.0}, "data": {}}, {"kind": "x", "meta": {"n": "40"}, "data": {}}])
    tried = {"apostrophe": ("it's", "a"), "backslash": ("a\\b", "b"), "dot": ("a.b", 1), "number": ("n", 40)}
    return spark.createDataFrame([(what, log.scan(0, Filter().meta(*kv)).count()) for what, kv in tried.items()], "what string, n bigint")


@query("index_meta_filter", "F15 R8", f"select position, stream, kind from log where {_K} = 69 and kind = 'view'")
def _(spark, d):
    log = own_log(spark, d)
    log.index_meta("k")
    log.index_meta("k")  # again is no error
    log.reclaim(grace=0)
    return log.scan(0, Filter.of_kinds(["view"]).meta("k", 69)).select("position", "stream", "kind")


@query("unique_meta_guard", "Q11 F15", f"select * from (values {_values([('new', 'ok'), ('again', 'Validation'), ('twice', 'Validation'), ('number', 'ok'), ('other', 'ok')])}) t(what, outcome)", view=False)
def _(spark, d):
    log = EventLog.open(spark, new_root(spark), OpenOptions(unique_meta=("id",)))
    s = log.stream("s")
    tried = {"new": [ev("x", id="1")], "again": [ev("x", id="1")], "twice": [ev("x", id="2"), ev("x", id="2")], "number": [ev("x", id=1)], "other": [ev("x", id="2"), ev("x")]}
    return spark.createDataFrame([(what, _refused(lambda e=e: s.append_many(e))) for what, e in tried.items()], "what string, outcome string")


# evolution


def _paid(e: dict[str, Any]) -> dict[str, Any]:
    return e | {"kind": "order_paid", "_schema_version": 3} if (e["kind"], e["_schema_version"]) == ("purchase", 2) else e


def _paid_frame(df: DataFrame) -> DataFrame:
    step = (F.col("kind") == "purchase") & (F.col("schema_version") == 2)
    return df.withColumns({"kind": F.when(step, "order_paid").otherwise(F.col("kind")), "schema_version": F.when(step, 3).otherwise(F.col("schema_version"))})


_UPCAST = "position, case when kind = 'purchase' then 3 else schema_version end::bigint as schema_version, case when kind = 'purchase' then 'order_paid' else kind end as current_kind"


@query("upcast_kind_version", "F12 U1", f"select {_UPCAST} from log")
def _(spark, d):
    return source_log(spark, d, OpenOptions(upcasters=(Upcaster(_paid, _paid_frame),))).scan().select("position", "schema_version", F.col("kind").alias("current_kind"))


@query("upcast_by_rows", "F12 U1 J3 F14", f"select {_UPCAST} from log where position > 200 order by position limit 400")
def _(spark, d):
    log = source_log(spark, d, OpenOptions(upcasters=(Upcaster(_paid),)))
    rows = [(r.position, r.event["_schema_version"], r.kind) for r in log.read_all(200, limit=200)]
    rest = log.scan(400, limit=200).select("position", "schema_version", F.col("kind").alias("current_kind"))
    return spark.createDataFrame(rows, "position bigint, schema_version bigint, current_kind string").unionByName(rest)


@query("filters_see_stored_kinds", "F10", "select 'purchase' as asked, count(*) as n, 'order_paid' as got from log where kind = 'purchase' union all select 'order_paid', 0, null")
def _(spark, d):
    log = source_log(spark, d, OpenOptions(upcasters=(Upcaster(_paid, _paid_frame),)))
    ask = lambda k: log.scan(0, Filter.of_kinds([k])).agg(F.lit(k).alias("asked"), F.count(F.lit(1)).alias("n"), F.max("kind").alias("got"))
    return ask("purchase").unionByName(ask("order_paid"))


@query("current_check", "F13", f"select * from (values {_values([('no kind', 'Corruption'), ('no version', 'Corruption'), ('whole', 'ok')])}) t(step, outcome)", view=False)
def _(spark, d):
    steps = {"no kind": lambda e: {k: v for k, v in e.items() if k != "kind"}, "no version": lambda e: {k: v for k, v in e.items() if k != "_schema_version"}, "whole": lambda e: e}
    return spark.createDataFrame([(what, _refused(lambda f=f: source_log(spark, d, OpenOptions(upcasters=(Upcaster(f),))).read_all(limit=3))) for what, f in steps.items()], "step string, outcome string")


# aggregates and listings


@query("head_position", "A1", "select coalesce(max(position), 0)::bigint as head from log")
def _(spark, d):
    return spark.createDataFrame([(source_log(spark, d).head_position(),)], "head bigint")


_SOME = [f"user-{i}" for i in range(8)]
_SOME_SQL = ", ".join(f"'{s}'" for s in _SOME)


@query("stream_head_len", "A2 A3 A4 S12", f"select stream, max(seq) as head, count(*) as n, false as empty from log where stream in ({_SOME_SQL}) group by stream union all select 'nobody', null, 0, true")
def _(spark, d):
    log = source_log(spark, d)
    return spark.createDataFrame([(s, (h := log.stream(s)).head(), h.len(), h.is_empty()) for s in [*_SOME, "nobody"]], "stream string, head bigint, n bigint, empty boolean")


@query("stream_head_len_retained", "A2 A3 A4 R4", f"select stream, max(seq) filter (where position > 400) as head, count(*) filter (where position > 400) as n from log where stream in ({_SOME_SQL}) group by stream")
def _(spark, d):
    log = own_log(spark, d)
    log.retain(Plan.before(400), Guard.FORCE)
    return spark.createDataFrame([(s, log.stream(s).head(), log.stream(s).len()) for s in _SOME], "stream string, head bigint, n bigint")


@query("list_streams_prefix_page", "L1 O5 A9 W9", "select stream, max(seq) as head_seq from log where starts_with(stream, 'user-1') and stream > 'user-110' group by stream order by stream limit 20")
def _(spark, d):
    return source_log(spark, d).streams("user-110", "user-1", 20)


@query("list_streams_by_pages", "L1 O5", "select stream, max(seq) as head_seq from log group by stream")
def _(spark, d):
    log, after, got = source_log(spark, d), None, []
    while page := log.streams(after, limit=400).collect():
        got, after = got + page, page[-1].stream
    return spark.createDataFrame([tuple(r) for r in got], "stream string, head_seq bigint")


@query("list_kinds", "L2 A10", "select distinct kind from log where kind > 'click' order by kind")
def _(spark, d):
    return source_log(spark, d).kinds("click")


@query("list_kinds_retained", "L2 R4", "select distinct kind from log where position > (select max(position) from log) - 3")
def _(spark, d):
    log = own_log(spark, d)
    log.retain(Plan.before(log.head_position() - 3), Guard.FORCE)
    return log.kinds()


@query("list_checkpoints", "L3 T3", f"select * from (values {_values([('b', 20), ('c', 5)])}) t(consumer, position)", view=False)
def _(spark, d):
    log = empty_log(spark)
    for consumer, position in (("a", 1), ("b", 2), ("c", 5), ("b", 20)):
        log.checkpoint_save(consumer, position)
    return log.checkpoints("a").select("consumer", "position")


@query("checkpoint_load", "T3", f"select * from (values {_values([('a', 7), ('never', 0)])}) t(consumer, position)", view=False)
def _(spark, d):
    log = empty_log(spark)
    log.checkpoint_save("a", 7)
    return spark.createDataFrame([(c, log.checkpoint_load(c)) for c in ("a", "never")], "consumer string, position bigint")


@query("cursor_bounds", "O7", f"select * from (values {_values([('position', 'Validation'), ('negative', 'Validation'), ('ledger id', 'ok'), ('receipt id', 'ok'), ('plan', 'Validation')])}) t(what, outcome)", view=False)
def _(spark, d):
    log = source_log(spark, d)
    tried = {"position": lambda: log.read_all(2**63), "negative": lambda: log.read_all(-1), "ledger id": lambda: log.retention_ledger(2**64).collect(), "receipt id": lambda: log.export_receipts(2**64).collect(), "plan": lambda: Plan.before(2**63)}
    return spark.createDataFrame([(k, _refused(f)) for k, f in tried.items()], "what string, outcome string")


# writing


@query("append_modes", "W1 W2 W4 W8 W9 F14", f"select * from (values {_values([('one', 1, 1, None), ('many', 2, 2, None), ('many', 3, 3, None), ('other', 1, 4, None), ('at', 4, 5, 99), ('next', 5, 6, None)])}) t(what, seq, position, epoch_ms)", view=False)
def _(spark, d):
    log = empty_log(spark)
    s, out = log.stream("s"), []
    put = lambda what, c, ms=None: out.append((what, c.seq, c.position, ms))
    put("one", s.append(ev("a")))
    for c in s.append_many([ev("b"), ev("c")]):
        put("many", c)
    put("other", log.stream("t").append(ev("a")))
    put("at", c := s.append_at(99, ev("old")), c.epoch_ms)
    put("next", s.append(ev("d")))
    assert s.append_many([]) == []
    return spark.createDataFrame(out, "what string, seq bigint, position bigint, epoch_ms bigint")


@query("append_small_segments", "W1 W8 W18", "select i as position, 's' || (i % 3) as stream, (i + 2) // 3 as seq from range(1, 101) t(i)", view=False)
def _(spark, d):
    log = empty_log(spark)
    for i in range(1, 101):
        log.stream(f"s{i % 3}").append(ev("x", i=i))
    assert len(log.manifest.state.segments) < 40  # merged in tiers
    return log.scan().select("position", "stream", "seq")


@query("append_expecting", "W5", f"select * from (values {_values([(None, 'ok', None), (None, 'HeadMismatch', 1), (1, 'ok', None), (5, 'HeadMismatch', 2)])}) t(expected, outcome, actual)", view=False)
def _(spark, d):
    s, out = empty_log(spark).stream("s"), []
    for expected in (None, None, 1, 5):
        try:
            s.append_expecting(expected, ev("x"))
            out.append((expected, "ok", None))
        except HeadMismatch as e:
            out.append((e.expected, "HeadMismatch", e.actual))
    return spark.createDataFrame(out, "expected bigint, outcome string, actual bigint")


@query("append_expecting_counter", "W5 R4 A9", "select max(seq) as expected, max(seq) + 1 as seq from log where stream = 'user-7'")
def _(spark, d):
    log = own_log(spark, d)
    log.retain(Plan.streams(["user-7"]), Guard.FORCE)  # its counter stays
    expected = log.streams(prefix="user-7").where("stream = 'user-7'").first().head_seq
    return spark.createDataFrame([(expected, log.stream("user-7").append_expecting(expected, ev("x")).seq)], "expected bigint, seq bigint")


@query("detached_appends", "W6 S16", "select i as seq, 'k' || i as kind from range(1, 21) t(i)", view=False)
def _(spark, d):
    log = empty_log(spark)
    for i in range(1, 21):
        log.detach_append("s", ev(f"k{i}"))
    log.shutdown()
    return spark.createDataFrame([(e["seq"], e["kind"]) for e in log.stream("s").read()], "seq bigint, kind string")


@query("retrying_write", "W18", f"select * from (values {_values([(2, 3, 'ok'), (4, 5, 'ok'), (9, 5, 'Busy')])}) t(busy, attempts, outcome)", view=False)
def _(spark, d):
    out = []
    for busy in (2, 4, 9):
        tries = []

        def write(busy=busy, tries=tries):
            tries.append(1)
            if len(tries) <= busy:
                raise Busy("held")

        outcome = _refused(lambda write=write: retrying(write))
        out.append((busy, len(tries), outcome))
    return spark.createDataFrame(out, "busy bigint, attempts bigint, outcome string")


_DECIDE = "sum(case kind when 'purchase' then 1 when 'error' then -1 else 0 end)::bigint"


@query("decision_balance", "W3 U2 A11", f"select stream, {_DECIDE} as balance, case when {_DECIDE} > 0 then count(*) + 1 end as landed from log where stream in ({_SOME_SQL}) group by stream")
def _(spark, d):
    log, out = own_log(spark, d), []
    for name in _SOME:
        seen: list[int] = []

        def decide(events, seen=seen):
            seen.append(sum(1 if e["kind"] == "purchase" else -1 for e in events))
            return ev("settled", {"balance": seen[0]}) if seen[0] > 0 else None

        c = log.stream(name).append_if(["purchase", "error"], decide)
        out.append((name, seen[0], None if c is None else c.seq))
    return spark.createDataFrame(out, "stream string, balance bigint, landed bigint")


_BAD_NEW = [
    ({"kind": "a", "meta": {}, "data": {}}, "ok"), ({"kind": ""}, "Validation"), ({}, "Validation"), ({"kind": "a", "seq": 1}, "Validation"), ({"kind": "a", "epoch_ms": 1}, "Validation"), ({"kind": "a", "extra": 1}, "Validation"),
    ({"kind": "a", "data": []}, "Validation"), ({"kind": "a", "meta": {"x": None}}, "Validation"), ({"kind": "a", "meta": {"x": [1]}}, "Validation"), ({"kind": "a", "meta": {"x": True}}, "ok"), ({"kind": "a", "_schema_version": 3}, "ok"), ({"kind": "a", "_schema_version": -1}, "Validation"),
]
_BAD_STORED = [({"kind": "a", "epoch_ms": 1, "_schema_version": 1, "seq": 4}, "ok"), ({"kind": "a", "epoch_ms": 1}, "Validation"), ({"kind": "a", "_schema_version": 1}, "Validation"), ({"kind": "a", "epoch_ms": -1, "_schema_version": 1}, "Validation"), ({"kind": "a", "epoch_ms": 1, "_schema_version": 1, "seq": "x"}, "Validation"), ([], "Validation")]


@query("validate_envelopes", "W11 W12", f"select * from (values {_values([('new', i, o) for i, (_, o) in enumerate(_BAD_NEW)] + [('stored', i, o) for i, (_, o) in enumerate(_BAD_STORED)])}) t(what, i, outcome)", view=False)
def _(spark, d):
    out = [("new", i, _refused(lambda e=e: envelope.validate(e))) for i, (e, _) in enumerate(_BAD_NEW)] + [("stored", i, _refused(lambda e=e: envelope.validate_stored(e))) for i, (e, _) in enumerate(_BAD_STORED)]
    return spark.createDataFrame(out, "what string, i bigint, outcome string")


@query("stamp_and_restamp", "W13", f"select * from (values {_values([('new', 7, 50, 1, '{}', '{}'), ('kept', 9, 3, 4, '{}', '{}')])}) t(what, seq, epoch_ms, version, meta, data)", view=False)
def _(spark, d):
    a, b = envelope.stamp({"kind": "x"}, 7, 50), envelope.restamp({"kind": "x", "epoch_ms": 3, "_schema_version": 4, "seq": 2}, 9)
    return spark.createDataFrame([(what, e["seq"], e["epoch_ms"], e["_schema_version"], json.dumps(e["meta"]), json.dumps(e["data"])) for what, e in (("new", a), ("kept", b))], "what string, seq bigint, epoch_ms bigint, version bigint, meta string, data string")


@query("transaction_all_or_nothing", "U11 U13 W7", f"select * from (values {_values([('failed', 0, 0, 0), ('done', 2, 9, 1)])}) t(what, events, checkpoint, tables)", view=False)
def _(spark, d):
    log, out = empty_log(spark), []
    for what in ("failed", "done"):
        try:
            with log.transaction() as t:
                t.append("a", ev("x"))
                t.append("b", ev("x"))
                t.checkpoint_save("c", 9)
                t.execute("create table notes (id bigint)")
                if what == "failed":
                    raise KeyError(what)
        except KeyError:
            pass
        out.append((what, log.head_position(), log.checkpoint_load("c"), len(log.manifest.state.tables)))
    return spark.createDataFrame(out, "what string, events bigint, checkpoint bigint, tables bigint")


# transfer


@query("export_records", "R9 F11", f"select {_SHOWN} from log order by position limit 100")
def _(spark, d):
    return _rows(spark, source_log(spark, d).export(limit=100))


@query("export_frame", "R9 S2", f"select {_SHOWN}, v from log where kind = 'error'")
def _(spark, d):
    record = "stream string, position bigint, event struct<kind: string, meta: struct<k: bigint>, data: struct<value: double>, _schema_version: bigint, seq: bigint, epoch_ms: bigint>"
    r = source_log(spark, d).export_frame(0, Filter.of_kinds(["error"])).select(F.from_json("record", record).alias("r"))
    return r.select("r.position", "r.stream", "r.event.seq", "r.event.epoch_ms", "r.event.kind", F.col("r.event._schema_version").alias("schema_version"), F.format_string('{"k": %d}', "r.event.meta.k").alias("meta"), F.col("r.event.data.value").alias("v"))


@query("import_reassign_coordinates", "W9 W10", "select stream, epoch_ms, (row_number() over (order by position))::bigint as position, (row_number() over (partition by stream order by position))::bigint as seq from log where kind = 'signup'")
def import_reassign_coordinates(spark, d):
    log = empty_log(spark)
    log.import_frame(source_log(spark, d).stored(0, Filter.of_kinds(["signup"])), ["position"])
    return log.scan().select("stream", "epoch_ms", "position", "seq")


@query("import_reproduced_flag", "W10 J4 S14", "select 'whole' as what, count(*) as imported, 1::bigint as first, count(*) as last, true as reproduced from log union all select 'part', count(*), 1, count(*), false from log where kind = 'view' union all select 'none', 0, null, null, true")
def _(spark, d):
    source, out = source_log(spark, d), []
    for what, rows in (("whole", source.stored()), ("part", source.stored(0, Filter.of_kinds(["view"]))), ("none", source.stored(0, Filter.of_kinds([])))):
        r = empty_log(spark).import_frame(rows, ["position"])
        out.append((what, r.imported, r.first, r.last, r.reproduced_coordinates))
    return spark.createDataFrame(out, "what string, imported bigint, first bigint, last bigint, reproduced boolean")


@query("log_sink", "W15 W10 J4 A13", "select 'all' as what, least(count(*), 900) as imported, true as reproduced from log union all select 'views', count(*), false from (select * from log where kind = 'view' and position > 1 order by position limit 100)")
def _(spark, d):
    source, out = source_log(spark, d), []
    for what, f, from_, n in (("all", Filter(), 0, 900), ("views", Filter.of_kinds(["view"]), 1, 100)):
        sink, at = LogSink(empty_log(spark)), from_
        while page := source.export(at, f, min(300, n - sink.imported)):
            sink.write(page)
            at = page[-1].position
            if sink.imported >= n:
                break
        sink.write([])
        out.append((what, sink.imported, sink.reproduced_coordinates))
    return spark.createDataFrame(out, "what string, imported bigint, reproduced boolean")


@query("json_lines_sink", "W14 W16 S13", f"select {_SHOWN} from log where kind = 'purchase' order by position limit 80")
def _(spark, d):
    out = io.StringIO()
    JsonLinesSink(out).write(source_log(spark, d).export(0, Filter.of_kinds(["purchase"]), 80))
    return _rows(spark, read_json_lines(out.getvalue().splitlines()))


@query("json_lines_in_bulk", "S13 W10 R9", "select position, stream, seq, epoch_ms, kind, schema_version, json_extract(meta, '$.k')::bigint as k from log")
def _(spark, d):
    path, log = new_root(spark), empty_log(spark)
    source_log(spark, d).export_frame().select("record").write.text(path)
    rows = read_records(spark, path)
    report = log.import_frame(rows.withColumnRenamed("witness", "position").drop("ord"), ["position"])
    assert report.reproduced_coordinates
    return log.scan().select("position", "stream", "seq", "epoch_ms", "kind", "schema_version", F.get_json_object("meta", "$.k").cast("bigint").alias("k"))


_BAD_LINES = [('{"stream":"s","event":{"kind":"a","epoch_ms":1,"_schema_version":1}}', "ok"), ('{"stream":"","event":{"kind":"a","epoch_ms":1,"_schema_version":1}}', "Validation"), ('{"stream":"s","position":-1,"event":{"kind":"a","epoch_ms":1,"_schema_version":1}}', "Validation"), ('{"stream":"s"}', "Validation"), ("[1]", "Validation"), ("nonsense", "Validation"), ("", "ok")]


@query("json_lines_checked", "S13", f"select * from (values {_values([(i, o) for i, (_, o) in enumerate(_BAD_LINES)])}) t(i, outcome)", view=False)
def _(spark, d):
    return spark.createDataFrame([(i, _refused(lambda x=x: read_json_lines([x]))) for i, (x, _) in enumerate(_BAD_LINES)], "i bigint, outcome string")


@query("backup_copy", "W17", "select count(*) as n, max(position) as head, true as refused, sum(position)::bigint as positions from log")
def _(spark, d):
    log = own_log(spark, d)
    again = _refused(lambda: source_log(spark, d).backup_to(log.database())) == "Validation"
    return log.scan().agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("head"), F.lit(again).alias("refused"), F.sum("position").alias("positions"))


@query("orders_as_log", "S14 W10 L1", "select 'cust-' || o_custkey as stream, count(*) as head_seq from orders group by o_custkey", view=False)
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    rows = o.select(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("stream"), F.lit("ordered").alias("kind"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("epoch_ms"), F.lit(1).cast("bigint").alias("schema_version"), F.to_json(F.struct(F.col("o_orderkey").alias("key"))).alias("meta"), F.lit("{}").alias("data"), "o_orderkey")
    log = empty_log(spark)
    log.import_frame(rows, ["o_orderkey"])
    return log.streams()


@query("conversations_as_log", "S14 W10 L1", "select 'conv-' || conv_id as stream, count(*) as head_seq, count(*) filter (where role = 'user') as asked from conversations group by conv_id", view=False)
def _(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    log = empty_log(spark)
    log.append_frame(c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("stream"), F.col("role").alias("kind"), F.lit(0).cast("bigint").alias("epoch_ms"), F.lit(1).cast("bigint").alias("schema_version"), F.lit("{}").alias("meta"), F.to_json(F.struct("text")).alias("data"), "conv_id", "turn"), ["conv_id", "turn"])
    asked = log.scan(0, Filter.of_kinds(["user"])).groupBy("stream").agg(F.count(F.lit(1)).alias("asked"))
    return log.streams().join(asked, "stream", "left").select("stream", "head_seq", F.coalesce("asked", F.lit(0)).alias("asked"))


# retention


@query("retain_before_tally", "A5 R1 R4", "select count(*) as removed, max(position) as highest, count(distinct stream) as streams from log where position <= 400")
def _(spark, d):
    r = own_log(spark, d).retain(Plan.before(400), Guard.FORCE)
    return spark.createDataFrame([(r.removed, r.highest_removed, r.streams_affected)], "removed bigint, highest bigint, streams bigint")


@query("retain_older_than_survivors", "R1 R4 S1", "select position, stream, epoch_ms from log where not (epoch_ms < 1705000000000)")
def _(spark, d):
    log = own_log(spark, d)
    log.retain(Plan.older_than(1705000000000), Guard.FORCE)
    return log.scan().select("position", "stream", "epoch_ms")


@query("retain_streams_survivors", "R1 R4 A1", "select count(*) as n, min(position) as first, max(position) as last from log where stream not in ('user-1', 'user-2', 'user-3')")
def _(spark, d):
    log = own_log(spark, d)
    log.retain(Plan.streams(["user-1", "user-2", "user-3"]), Guard.FORCE)
    return log.scan().agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


@query("retain_keeps_counters", "A9 R4 L1", "select stream, max(seq) as head_seq, count(*) filter (where position > 400) as live from log group by stream")
def _(spark, d):
    log = own_log(spark, d)
    log.retain(Plan.before(400), Guard.FORCE)
    live = log.scan().groupBy("stream").agg(F.count(F.lit(1)).alias("live"))
    return log.streams().join(live, "stream", "left").select("stream", "head_seq", F.coalesce("live", F.lit(0)).alias("live"))


@query("retained_read_crosses_holes", "R4 S1 O1", f"select {_SHOWN} from log where position > 390 and stream not in ({_SOME_SQL}) order by position limit 100")
def _(spark, d):
    log = own_log(spark, d)
    log.retain(Plan.streams(_SOME), Guard.FORCE)
    return _rows(spark, log.read_all(390, limit=100))


@query("retain_nothing", "R4 L4", f"select * from (values {_values([(0, None, 0, 0)])}) t(removed, highest, streams, ledger)", view=False)
def _(spark, d):
    log = own_log(spark, d)
    r = log.retain(Plan.streams([]), Guard.FORCE)
    return spark.createDataFrame([(r.removed, r.highest_removed, r.streams_affected, log.retention_ledger().count())], "removed bigint, highest bigint, streams bigint, ledger bigint")


@query("retention_ledger", "L4 R2 A7", "select 1::bigint as id, 'before:100' as plan, count(*) as removed_count, max(position) as highest_removed, 400::bigint as mark from log where position <= 100 union all select 2, 'streams:8', count(*), max(position), (select max(position) from log where position <= 400 and stream in (" + _SOME_SQL + ")) from log where position between 101 and 400 and stream in (" + _SOME_SQL + ")")
def _(spark, d):
    log = own_log(spark, d)
    log.retain(Plan.before(log.head_position()), Guard.REGISTERED_CONSUMERS) if log.head_position() < 100 else log.retain(Plan.before(100))
    log.retain(Plan.streams(_SOME), Guard.FORCE)
    return log.retention_ledger().select("id", "plan", "removed_count", "highest_removed").withColumn("mark", F.lit(log.removed_watermark()))


SQL["retention_ledger"] = _VIEW + f", s as (select * from log where position > 100 and stream in ({_SOME_SQL})) select 1::bigint as id, 'before:100' as plan, count(*) as removed_count, max(position) as highest_removed, (select max(position) from s) as mark from log where position <= 100 union all select 2, 'streams:8', count(*), max(position), max(position) from s"


@query("completeness_from", "R7 A7", "select c as cursor, c >= 400 as complete, case when c < 400 then 400 end::bigint as removed_up_to from (values (10::bigint), (399), (400), (900)) t(c)", view=False)
def _(spark, d):
    log = own_log(spark, d)
    log.retain(Plan.before(400), Guard.FORCE)
    return spark.createDataFrame([(c, (x := log.completeness_from(c)).complete, x.removed_up_to) for c in (10, 399, 400, 900)], "cursor bigint, complete boolean, removed_up_to bigint")


@query("require_complete", "R7 T11", f"select * from (values {_values([(10, 10, 400), (400, None, None)])}) t(cursor, requested, removed_up_to)", view=False)
def _(spark, d):
    log, out = own_log(spark, d), []
    log.retain(Plan.before(400), Guard.FORCE)
    for c in (10, 400):
        try:
            log.require_complete_from(c)
            out.append((c, None, None))
        except Truncated as e:
            out.append((c, e.requested, e.removed_up_to))
    return spark.createDataFrame(out, "cursor bigint, requested bigint, removed_up_to bigint")


@query("consumer_lag", "R3 R5 O6", "select consumer, position, 400::bigint as up_to from (values ('slow', 120::bigint), ('late', 399), ('fast', 900)) c(consumer, position) where position < 400 order by position limit 1", view=False)
def _(spark, d):
    log = own_log(spark, d)
    for c, p in (("late", 399), ("slow", 120), ("fast", 900)):
        log.checkpoint_save(c, p)
    try:
        log.retain(Plan.before(400))
        out = []
    except ConsumerBehind as e:
        out = [(e.consumer, e.cursor, e.up_to)]
    return spark.createDataFrame(out, "consumer string, position bigint, up_to bigint")


@query("retain_guards", "R3 R5 R6 A6", f"select * from (values {_values([('consumers', 'ConsumerBehind', 400, 50), ('exported', 'NotExported', 400, 0), ('exported, behind', 'ConsumerBehind', 400, 50), ('force', 'ok', 400, None)])}) t(guard, outcome, up_to, reached)", view=False)
def _(spark, d):
    log, out = own_log(spark, d), []
    log.checkpoint_save("c", 50)
    for what, guard in (("consumers", Guard.REGISTERED_CONSUMERS), ("exported", Guard.EXPORTED), ("exported, behind", Guard.EXPORTED), ("force", Guard.FORCE)):
        if what == "exported, behind":
            log.confirm_export(log.export_recorded(0, limit=500)[1].id)
        try:
            out.append((what, "ok", log.retain(Plan.before(400), guard).highest_removed, None))
        except ConsumerBehind as e:
            out.append((what, "ConsumerBehind", e.up_to, e.cursor))
        except NotExported as e:
            out.append((what, "NotExported", e.up_to, e.exported_through))
    return spark.createDataFrame(out, "guard string, outcome string, up_to bigint, reached bigint")


_RECEIPTS = [(0, 100, True, True), (100, 150, True, True), (250, 50, True, False), (200, 80, True, True), (280, 120, False, True), (350, 150, True, True)]


@query(
    "export_chain_reach",
    "A8 R10 R11",
    f"""with r(f, n, whole, landed) as (values {', '.join(map(str, _RECEIPTS))}),
i as (select f, max(p.position)::bigint as t, whole, landed from r, (select event_id + 1 as position, event_type as kind from events) p where p.position > f and p.position <= f + n and (whole or kind = 'view') group by all),
k as (select f, t, coalesce(max(t) over (order by f, t rows between unbounded preceding and 1 preceding), 0) as prev from i where whole and landed),
g as (select t, sum(case when f > prev then 1 else 0 end) over (order by f, t) as gap from k)
select coalesce(max(t), 0)::bigint as reach from g where gap = 0""",
    view=False,
)
def _(spark, d):
    log = own_log(spark, d)
    for from_, n, whole, landed in _RECEIPTS:
        _, receipt = log.export_recorded(from_, Filter() if whole else Filter.of_kinds(["view"]), n)
        if landed:
            log.confirm_export(receipt.id)
            log.confirm_export(receipt.id)  # again is no error
    return spark.createDataFrame([(log.exported_through(),)], "reach bigint")


@query("export_receipts", "L5 R10 R11", "select 1::bigint as id, 0::bigint as from_position, 100::bigint as through, 100::bigint as count, true as whole, true as landed union all select 2, 100, max(position), 20, false, false from (select position from log where kind = 'view' and position > 100 order by position limit 20)")
def _(spark, d):
    log = own_log(spark, d)
    log.confirm_export(log.export_recorded(0, limit=100)[1].id)
    log.export_recorded(100, Filter.of_kinds(["view"]), 20)
    assert _refused(lambda: log.confirm_export(99)) == "Validation"
    return log.export_receipts().select("id", "from_position", "through", "count", "whole", F.col("landed_ms").isNotNull().alias("landed"))


class _Pages(Sink):
    def __init__(self):
        self.pages: list[list[ExportedEvent]] = []

    def write(self, page):
        self.pages.append(page)


@query("archive_then_retain", "R12 W16 U4", f"select (p.i + 1)::bigint as page, count(*) as n, max(position) as through, (select count(*) from log where position <= 400) as removed from log, (select unnest(range(0, 4)) as i) p where position between p.i * 128 + 1 and least((p.i + 1) * 128, (select ceil(max(position) / 128) * 128 from log where position <= 400)) group by p.i")
def _(spark, d):
    log, sink = own_log(spark, d), _Pages()
    assert _refused(lambda: log.archive_then_retain(Plan.before(400), sink, 0)) == "Validation" and not sink.pages
    r = log.archive_then_retain(Plan.before(400), sink, 128)
    return spark.createDataFrame([(i, len(p), p[-1].position, r.removed) for i, p in enumerate(sink.pages, 1)], "page bigint, n bigint, through bigint, removed bigint")


@query("archive_in_bulk", "R12 W14", "select position, stream, json_extract(meta, '$.k')::bigint as k from log where position <= 700")
def _(spark, d):
    log, path = own_log(spark, d), new_root(spark)
    log.archive_then_retain(Plan.before(700), FrameSink(path))
    assert log.exported_through() == 700 == log.removed_watermark()
    return read_records(spark, f"{path}/*").select(F.col("witness").alias("position"), "stream", F.get_json_object("meta", "$.k").cast("bigint").alias("k"))


@query("reclaim_keeps_rows", "R8 W17", "select count(*) + 3 as n, max(position) + 3 as head, true as fewer from log where position > 200")
def _(spark, d):
    log = own_log(spark, d)
    for i in range(3):
        log.stream("s").append(ev(f"k{i}"))
    log.retain(Plan.before(200), Guard.FORCE)
    before = len(log.manifest.state.segments)
    gone = log.reclaim(grace=0)
    rows = log.scan().agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("head"))
    return rows.withColumn("fewer", F.lit(gone > 0 and len(log.manifest.state.segments) <= before))


# streaming and projections


class Totals(Projection):
    """Purchases of each stream; a batch replaces the rows of the streams it names."""

    name, kinds, keys = "totals", ("purchase",), ("stream",)

    def init(self, log):
        return log.spark.createDataFrame([], "stream string, cents bigint, n bigint, cursor bigint")

    def apply(self, batch, model):
        value = F.get_json_object("data", "$.value").cast("double")
        new = batch.groupBy("stream").agg(F.sum(F.round(value * 100).cast("bigint")).alias("c"), F.count(F.lit(1)).alias("k"), F.max("position").alias("p"))
        both = new.join(model, "stream", "left")
        return both.select("stream", (F.col("c") + F.coalesce("cents", F.lit(0))).alias("cents"), (F.col("k") + F.coalesce("n", F.lit(0))).alias("n"), F.col("p").alias("cursor"))


class Kinds(Projection):
    """Events of each kind; every batch gives the whole model."""

    name = "kinds"

    def init(self, log):
        return log.spark.createDataFrame([], "kind string, n bigint")

    def apply(self, batch, model):
        return model.unionByName(batch.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))).groupBy("kind").agg(F.sum("n").alias("n"))


_TOTALS = "select stream, sum(cast(round(v * 100) as bigint))::bigint as cents, count(*) as n, max(position) as cursor from log where kind = 'purchase' group by stream"


@query("projection_totals", "T4 T6 U3 A12", _TOTALS)
def _(spark, d):
    with ProjectionRunner(own_log(spark, d), Totals()) as runner:
        runner.catch_up_bulk()
        return runner.model()


@query("projection_by_batches", "T4 T5 T6 T9 A12", _TOTALS)
def _(spark, d):
    log = own_log(spark, d)
    with ProjectionRunner(log, Totals()).with_batch(-(-log.scan(0, Filter.of_kinds(["purchase"])).count() // 3)) as runner:
        assert runner.catch_up() == runner.model().agg(F.sum("n")).first()[0] and runner.position() == log.head_position()
        return runner.model()


@query("projection_steps", "T5 T9", "select (i + 1)::bigint as step, least(100, greatest(n - 100 * i, 0))::bigint as applied, case when n >= 100 * (i + 1) then (select position from log where kind = 'purchase' order by position limit 1 offset (100 * i + 99)) else (select max(position) from log) end as position from (select count(*) as n from log where kind = 'purchase'), range(0, 3) r(i)")
def _(spark, d):
    log, out = own_log(spark, d), []
    with ProjectionRunner(log, Totals(), 100) as runner:
        for i in range(3):
            out.append((i + 1, runner.run_once(), runner.position()))
    return spark.createDataFrame(out, "step bigint, applied bigint, position bigint")


SQL["projection_steps"] = _VIEW + ", p as (select position, row_number() over (order by position) as r, count(*) over () as n from log where kind = 'purchase') select (i + 1)::bigint as step, least(100, greatest(n - 100 * i, 0))::bigint as applied, coalesce((select position from p where r = 100 * (i + 1)), (select max(position) from log)) as position from (select max(n) as n from p), range(0, 3) r(i)"


@query("projection_sees_upcasts", "T5 F12", "select case when kind = 'purchase' then 'order_paid' else kind end as kind, count(*) as n from log group by all")
def _(spark, d):
    root = new_root(spark)
    source_log(spark, d).backup_to(root)
    with ProjectionRunner(EventLog.open(spark, root, OpenOptions(upcasters=(Upcaster(_paid, _paid_frame),))), Kinds()) as runner:
        runner.catch_up_bulk()
        return runner.model()


@query("projection_rebuild", "T8 T4", "select kind, count(*) as n from log group by kind")
def _(spark, d):
    log = own_log(spark, d)
    with ProjectionRunner(log, Kinds(), 100_000) as runner:
        runner.catch_up()
        runner.rebuild()
        return runner.model()


@query("projection_follow", "T7 T2", "select kind, count(*) as n from log group by kind union all select 'late', 2")
def _(spark, d):
    log, stop = own_log(spark, d), threading.Event()
    with ProjectionRunner(log, Kinds(), 100_000) as runner:
        thread = threading.Thread(target=runner.follow, args=(stop,), daemon=True)
        thread.start()
        log.stream("s").append_many([ev("late"), ev("late")])
        while thread.is_alive() and runner.position() < log.head_position():
            stop.wait(0.05)
        stop.set()
        thread.join()
        return runner.model()


@query("structured_streaming_follow", "T1 T6 S9", _TOTALS)
def _(spark, d):
    log = own_log(spark, d)
    with ProjectionRunner(log, Totals()) as runner:
        follow(runner, new_root(spark)).awaitTermination()
        return runner.model()


class _Failing(Kinds):
    name = "failing"

    def apply(self, batch, model):
        raise StorageError("the disk is gone")


class _Tolerant(Kinds):
    name, tolerates_truncation = "tolerant", True


@query("projection_refusals", "T10 T11 T12 T8", f"select * from (values {_values([('second runner', 'Validation'), ('released', 'ok'), ('truncated', 'Truncated'), ('rebuild', 'Truncated'), ('tolerant', 'ok'), ('failed', 'StorageError'), ('lost', 'StorageError'), ('fresh', 'ok')])}) t(what, outcome)", view=False)
def _(spark, d):
    log, out = own_log(spark, d), []
    put = lambda what, f: out.append((what, _refused(f)))
    first = ProjectionRunner(log, Kinds(), 100_000)
    put("second runner", lambda: ProjectionRunner(log, Kinds()))
    first.into_inner()
    second = ProjectionRunner(log, Kinds(), 100_000)
    put("released", lambda: None)
    log.retain(Plan.before(400), Guard.FORCE)
    put("truncated", second.run_once)
    put("rebuild", second.rebuild)
    put("tolerant", ProjectionRunner(log, _Tolerant(), 100_000).catch_up)
    other = own_log(spark, d)
    failing = ProjectionRunner(other, _Failing())
    put("failed", failing.run_once)
    put("lost", failing.run_once)
    put("fresh", ProjectionRunner(other, Kinds(), 100_000).run_once)
    return spark.createDataFrame(out, "what string, outcome string")


# the SQL door


def _door(name: str, covers: str, sql: str, duck: str, params: Any = None, view: bool = True) -> None:
    @query(name, covers, duck, view)
    def _(spark, d):
        return source_log(spark, d).query_frame(sql, params)


_door("hatch_select", "U5 Q1", "select position, stream, kind from events where kind = :kind and position > :from order by position limit 50", "select position, stream, kind from log where kind = 'click' and position > 90 order by position limit 50", {"kind": "click", ":from": 90})
_door("hatch_null_safe_equal", "Q2 Q5", "select count(*) as n from events where nullif(kind, 'view') <=> ?", "select count(*) as n from log where nullif(kind, 'view') is not distinct from null", [None])
_door("hatch_like", "Q3", "select position, kind from events where kind like 'p_r%'", "select position, kind from log where kind like 'p_r%'")
_door("hatch_group_having", "Q5 Q6", "select kind, count(*) as n, count(distinct stream) as streams, min(position) as first, max(position) as last, sum(seq) as seqs from events group by kind having count(*) > 100", "select kind, count(*) as n, count(distinct stream) as streams, min(position) as first, max(position) as last, sum(seq)::bigint as seqs from log group by kind having count(*) > 100")
_door("hatch_recursive_cte", "Q7", "with recursive t(n) as (select 1 union all select n + 1 from t where n < 130) select cast(sum(n) as bigint) as total, count(*) as n from t", "with recursive t(n) as (select 1 union all select n + 1 from t where n < 130) select sum(n)::bigint as total, count(*) as n from t", view=False)
_door("hatch_set_operations", "Q8", "(select stream from events where kind = 'purchase' intersect select stream from events where kind = 'error') except select stream from events where kind = 'signup' and position < 500", "(select stream from log where kind = 'purchase' intersect select stream from log where kind = 'error') except select stream from log where kind = 'signup' and position < 500")
_door("hatch_window_rank", "Q9", "select stream, position, rank() over (partition by stream order by epoch_ms desc, position) as r, lag(position) over (partition by stream order by position) as before from events where kind = 'purchase'", "select stream, position, (rank() over (partition by stream order by epoch_ms desc, position))::int as r, lag(position) over (partition by stream order by position) as before from log where kind = 'purchase'")
_door("hatch_json_extract", "Q10", "select position, json_extract(meta, '$.k') as k from events where kind like 'p%'", "select position, json_extract_string(meta, '$.k') as k from log where kind like 'p%'")
_door("hatch_scalars", "Q12 Q13", "select position, hex(kind) as h, cast(seq as string) as s, typeof(seq) as t, upper(kind) as u, substr(stream, 6, 2) as x, coalesce(nullif(seq % 2, 0), -1) as c from events where position <= 200", "select position, hex(kind) as h, seq::varchar as s, 'bigint' as t, upper(kind) as u, substr(stream, 6, 2) as x, coalesce(nullif(seq % 2, 0), -1) as c from log where position <= 200")
_door("hatch_describe", "Q14", "describe events", f"select * from (values {_values([(c, t, None) for c, t in _TYPES.items()] + [('data', 'string', None)])}) t(col_name, data_type, comment)", view=False)
_door("hatch_semi_anti", "J5 Q4", "select stream, 'semi' as how from (select distinct stream from events) s where exists (select 1 from events e where e.stream = s.stream and e.kind = 'error' and cast(json_extract(e.meta, '$.k') as bigint) > 90) union all select stream, 'anti' from (select distinct stream from events) s where not exists (select 1 from events e where e.stream = s.stream and e.kind = 'error' and cast(json_extract(e.meta, '$.k') as bigint) > 90)", "select stream, 'semi' as how from (select distinct stream from log) s where exists (select 1 from log e where e.stream = s.stream and e.kind = 'error' and json_extract(e.meta, '$.k')::bigint > 90) union all select stream, 'anti' as how from (select distinct stream from log) s where not exists (select 1 from log e where e.stream = s.stream and e.kind = 'error' and json_extract(e.meta, '$.k')::bigint > 90)")
_door("hatch_full_and_self_join", "J5", "select coalesce(a.seq, b.seq) as seq, a.position as a, b.position as b from (select * from events where stream = 'user-1') a full join (select * from events where stream = 'user-2') b on a.seq = b.seq", "select coalesce(a.seq, b.seq) as seq, a.position as a, b.position as b from (select * from log where stream = 'user-1') a full join (select * from log where stream = 'user-2') b on a.seq = b.seq")
_door("hatch_stream_seq", "Q1 L1 A9", "select stream, next_seq from stream_seq where stream < 'user-2'", "select stream, max(seq) + 1 as next_seq from log where stream < 'user-2' group by stream")


def _weights(log: EventLog) -> EventLog:
    with log.transaction() as t:
        t.execute("create table weights (kind string, weight bigint)")
        t.execute("insert into weights values ('click', 1), ('purchase', 10), ('signup', ?)", [5])
    return log


_WEIGHTS_SQL = "(values ('click', 1::bigint), ('purchase', 10), ('signup', 5)) w(kind, weight)"


@query("hatch_join", "J2 Q4 Q6", f"select kind, count(*) as n, sum(w.weight)::bigint as weight from log join {_WEIGHTS_SQL} using (kind) group by kind")
def _(spark, d):
    return _weights(own_log(spark, d)).query_frame("select e.kind, count(*) as n, sum(w.weight) as weight from events e join weights w on e.kind = w.kind group by e.kind")


@query("hatch_left_join_model", "J5 J2 U3", "select l.stream, l.n, coalesce(m.bought, 0)::bigint as bought from (select stream, count(*) as n from log group by stream) l left join (select stream, count(*) as bought from log where kind = 'purchase' group by stream) m on l.stream = m.stream")
def _(spark, d):
    log = own_log(spark, d)
    with ProjectionRunner(log, Totals()) as runner:
        runner.catch_up_bulk()
    return log.query_frame("select e.stream, count(*) as n, coalesce(max(t.n), 0) as bought from events e left join totals t on e.stream = t.stream group by e.stream")


@query("hatch_dml", "Q17 U11 U13", f"select * from (values {_values([('click', 2), ('purchase', 20), ('view', 7)])}) t(kind, weight)", view=False)
def _(spark, d):
    log = _weights(own_log(spark, d))
    with log.transaction() as t:
        t.execute("update weights set weight = weight * 2 where kind <> 'signup'")
        t.execute("delete from weights where kind = 'signup'")
        t.execute("insert into weights (kind, weight) select kind, 7 from events where kind = 'view' group by kind")
        t.execute("create table gone (id bigint)")
        t.execute("drop table gone")
    return log.query_frame("select kind, weight from weights")


@query("hatch_upsert", "Q18", f"select * from (values {_values([('click', 3), ('purchase', 10), ('signup', 5), ('view', 4)])}) t(kind, weight)", view=False)
def _(spark, d):
    log = _weights(own_log(spark, d))
    with log.transaction() as t:
        t.upsert_table("weights", spark.createDataFrame([("click", 3), ("view", 4)], "kind string, weight bigint"), ["kind"])
    return log.query_frame("select kind, weight from weights")


@query("hatch_show_tables", "Q16", f"select * from (values {_values([('checkpoints',), ('events',), ('exports',), ('retention',), ('stream_seq',), ('weights',)])}) t(name)", view=False)
def _(spark, d):
    return spark.createDataFrame(sorted((r["viewName"],) for r in _weights(own_log(spark, d)).query("show views")), "name string")


@query("hatch_explain", "Q15", "select true as scans, true as pushed", view=False)
def _(spark, d):
    plan = source_log(spark, d).query("explain select position from events where kind = 'click' and position > 7")[0]["plan"]
    return spark.createDataFrame([("FileScan parquet" in plan, "GreaterThan(position,7)" in plan and "EqualTo(kind,click)" in plan)], "scans boolean, pushed boolean")


_REFUSED = [
    ("insert into events select * from events", "Unsupported"), ("delete from events", "Unsupported"), ("drop view events", "Unsupported"), ("create table x as select 1 as a", "Unsupported"), ("set spark.sql.ansi.enabled=false", "Unsupported"),
    ("select * from parquet.`/tmp`", "Unsupported"), ("select * from parquet./**/`/tmp`", "Unsupported"), ("select * from `parquet`.`/tmp`", "Unsupported"), ("select * from default.events", "Unsupported"), ("select * from foreign_view", "Validation"), ("select (select max(v) from foreign_view) as a", "Validation"),
    ("with a as (select * from foreign_view) select * from a", "Validation"), ("select `reflect`('java.lang.System', 'exit', 0)", "Unsupported"), ("select * from identifier('foreign_view')", "Unsupported"), ("execute immediate 'select 1'", "Unsupported"), ("explain delete from events", "Unsupported"), ("selec", "Validation"),
    ("with a as (select 1 as x) select * from a", "ok"), ("select count(*) from events", "ok"),
]


@query("hatch_authorizer", "U12 U13 U5", f"select * from (values {_values(_REFUSED)}) t(statement, outcome)", view=False)
def _(spark, d):
    spark.range(3).selectExpr("id as v").createOrReplaceTempView("foreign_view")
    try:
        log = source_log(spark, d)
        return spark.createDataFrame([(s, _refused(lambda s=s: log.query(s))) for s, _ in _REFUSED], "statement string, outcome string")
    finally:
        spark.catalog.dropTempView("foreign_view")


_RESERVED = [(n, "Unsupported") for n in ("events", "stream_seq", "checkpoints", "retention", "exports")] + [("mine", "ok")]


@query("reserved_tables", "U12 U13", f"select * from (values {_values(_RESERVED)}) t(name, outcome)", view=False)
def _(spark, d):
    log = empty_log(spark)
    return spark.createDataFrame([(n, _refused(lambda n=n: log.with_transaction(lambda t: t.execute(f"create table {n} (a bigint)")))) for n, _ in _RESERVED], "name string, outcome string")


_PARAMS = [
    ("select ? as a", [1], "1"), ("select ? as a", [None], "null"), ("select ? as a", [True], "true"), ("select ? as a", [2.5], "2.5"), ("select ? as a", [[1, "x"]], '"[1, \\"x\\"]"'), ("select :n as a", {"n": "s"}, '"s"'), ("select :n as a", {":n": 1}, "1"),
    ("select ? as a", [], "Validation"), ("select ? as a", [1, 2], "Validation"), ("select :n as a", {}, "Validation"), ("select :n as a", {"n": 1, "m": 2}, "Validation"), ("select :n as a, ? as b", [1], "Validation"), ("select ? as a", [2**63], "Validation"), ("select ? as a", [float("nan")], "Validation"),
]


@query("hatch_params", "U8 U9", f"select * from (values {_values([(i, w) for i, (_, _, w) in enumerate(_PARAMS)])}) t(i, got)", view=False)
def _(spark, d):
    log, out = source_log(spark, d), []
    for i, (sql, params, _) in enumerate(_PARAMS):
        try:
            out.append((i, json.dumps(log.query(sql, params)[0]["a"])))
        except EvlogError as e:
            out.append((i, type(e).__name__))
    return spark.createDataFrame(out, "i bigint, got string")


_CELLS = [("cast('ab' as binary)", "Unsupported", "6162"), ("double('inf')", "Unsupported", "Inf"), ("double('-inf')", "Unsupported", "-Inf"), ("double('nan')", "Unsupported", "NaN"), ("1.5d", "1.5", "1.5"), ("null", "None", "None"), ("array(1, 2)", "[1, 2]", "[1, 2]")]


@query("hatch_cells", "U7 U10", f"select * from (values {_values(_CELLS)}) t(expression, strict, lossy)", view=False)
def _(spark, d):
    from evlog.hatch import QueryOptions

    log, out = source_log(spark, d), []
    for expression, _, _ in _CELLS:
        got = []
        for lossy in (False, True):
            try:
                got.append(str(log.query_with(f"select {expression} as a", None, QueryOptions(lossy=lossy))[0]["a"]))
            except EvlogError as e:
                got.append(type(e).__name__)
        out.append((expression, *got))
    return spark.createDataFrame(out, "expression string, strict string, lossy string")


@query("hatch_timeout", "U6 U7", f"select * from (values {_values([('late', 'Timeout'), ('in time', 'ok')])}) t(what, outcome)", view=False)
def _(spark, d):
    log = source_log(spark, d)
    slow = "select sum(a.id * b.id % 7) as s from range(10000000) a join range(1000000) b on a.id % 3 = b.id % 3"
    return spark.createDataFrame([("late", _refused(lambda: log.query_timeout(slow, None, 0.5))), ("in time", _refused(lambda: log.query_timeout("select 1 as a", None, 60)))], "what string, outcome string")


@query("instrumentation", "U14", f"select * from (values {_values([(s,) for s in sorted(('evlog.append', 'evlog.decide', 'evlog.export', 'evlog.hatch', 'evlog.index', 'evlog.open', 'evlog.project', 'evlog.reclaim', 'evlog.retain', 'evlog.backup', 'evlog.archive'))])}) t(span)", view=False)
def _(spark, d):
    seen: set[str] = set()

    class Handler(logging.Handler):
        def emit(self, record):
            assert "payload" not in str(record.__dict__.get("fields"))
            seen.add(getattr(record, "span", ""))

    handler, level = Handler(), trace.LOGGER.level
    trace.LOGGER.addHandler(handler)
    trace.LOGGER.setLevel(logging.DEBUG)
    try:
        log = empty_log(spark)
        s = log.stream("s")
        s.append(ev("a", {"x": "payload"}))
        s.append_if(None, lambda seen: None)
        log.export_recorded()
        log.query("select 1 as a")
        log.index_meta("k")
        with ProjectionRunner(log, Kinds()) as runner:
            runner.catch_up()
        log.backup_to(new_root(spark))
        log.archive_then_retain(Plan.before(1), _Pages())
        log.reclaim()
    finally:
        trace.LOGGER.removeHandler(handler)
        trace.LOGGER.setLevel(level)
    return spark.createDataFrame(sorted((x,) for x in seen if x), "span string")
