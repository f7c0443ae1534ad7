"""Projections, retention, exports, transfer, backup, the SQL door and streaming."""

import io
import logging
import threading

import pytest
from pyspark.sql import functions as F

from evlog.errors import ConsumerBehind, NotExported, Timeout, Truncated, Unsupported, Validation
from evlog.hatch import QueryOptions, cell
from evlog.log import EventLog
from evlog.operators.filters import Filter
from evlog.project import Projection, ProjectionRunner
from evlog.retention import Guard, Plan
from evlog.streaming.follow import follow
from evlog.streaming.source import EvlogSource, stream_frame
from evlog.transfer import ExportedEvent, JsonLinesSink, LogSink, Sink, read_json_lines


def fill(log, n, stream="s", kind="a"):
    return log.stream(stream).append_many([{"kind": kind, "data": {"n": i}} for i in range(1, n + 1)])


class Totals(Projection):
    name, kinds = "totals", ("scored",)
    broken = False

    def init(self, log):
        return log.spark.createDataFrame([], "stream string, total bigint")

    def apply(self, batch, model):
        if self.broken:
            raise ArithmeticError
        new = batch.groupBy("stream").agg(F.sum(F.get_json_object("data", "$.n").cast("bigint")).alias("total"))
        return model.unionByName(new).groupBy("stream").agg(F.sum("total").alias("total"))


def total(runner):
    return {r.stream: r.total for r in runner.model().collect()}


def test_projection(log):
    p = Totals()
    with ProjectionRunner(log, p) as runner:
        with pytest.raises(Validation):
            ProjectionRunner(log, Totals())
        fill(log, 3, kind="scored")
        assert runner.catch_up() == 3 and total(runner) == {"s": 6} and runner.position() == 3
        fill(log, 1, kind="noise")
        assert runner.catch_up() == 0 and runner.position() == 4  # a short batch goes to the head
        fill(log, 5, kind="scored")
        p.broken = True
        with pytest.raises(ArithmeticError):
            runner.run_once()
        assert total(runner) == {"s": 6} and runner.position() == 4
        p.broken = False
        assert runner.with_batch(2).run_once() == 2 and runner.position() == 6  # a full one to its last event
        assert runner.catch_up() == 3 and total(runner) == {"s": 21} and runner.position() == 9
    with ProjectionRunner(log, Totals()) as again:
        assert again.catch_up() == 0 and again.rebuild() == 8 and total(again) == {"s": 21}


def test_projection_follows_a_stream_query(log, tmp_path):
    fill(log, 4, kind="scored")
    with ProjectionRunner(log, Totals()) as runner:
        follow(runner, str(tmp_path / "c")).awaitTermination()
        assert total(runner) == {"s": 10} and runner.position() == 4
        fill(log, 2, kind="scored")
        follow(runner, str(tmp_path / "c")).awaitTermination()
        assert total(runner) == {"s": 13}
        stop = threading.Event()
        t = threading.Thread(target=runner.follow, args=(stop,))
        t.start()
        fill(log, 1, kind="scored")
        for _ in range(200):
            if runner.position() == 7:
                break
            stop.wait(0.1)
        stop.set()
        t.join(20)
        assert total(runner) == {"s": 14}


def test_retention_keeps_counters_and_ledger(log):
    fill(log, 5)
    assert log.retain(Plan.before(3)) .__dict__ == {"removed": 3, "highest_removed": 3, "streams_affected": 1}
    assert [r.position for r in log.read_all()] == [4, 5] and log.removed_watermark() == 3
    assert not log.completeness_from(0).complete and log.completeness_from(3).complete
    assert log.retain(Plan.before(3)).removed == 0 and log.retention_ledger().count() == 1
    log.retain(Plan.streams(["s"]), Guard.FORCE)
    assert log.head_position() == 0 and log.stream("s").is_empty()
    assert [r.plan for r in log.retention_ledger().collect()] == ["before:3", "streams:1"]
    assert log.stream("s").append({"kind": "a"})[0::2] == (6, 6)
    assert [(r.stream, r.head_seq) for r in log.streams().collect()] == [("s", 6)]
    assert log.retain(Plan.streams([])).removed == 0
    log.stream("t").append_at(1000, {"kind": "old"})
    assert log.retain(Plan.older_than(2000)).highest_removed == 7 and [r.kind for r in log.kinds().collect()] == ["a"]
    with pytest.raises(Validation):
        Plan.before(2**63)


def test_guards(log):
    fill(log, 5)
    log.checkpoint_save("slow", 2)
    log.checkpoint_save("fast", 5)
    with pytest.raises(ConsumerBehind) as e:
        log.retain(Plan.before(4))
    assert (e.value.consumer, e.value.cursor, e.value.up_to) == ("slow", 2, 4) and log.head_position() == 5
    log.checkpoint_save("slow", 4)
    with pytest.raises(NotExported):
        log.retain(Plan.before(4), Guard.EXPORTED)
    assert log.retain(Plan.before(4)).removed == 4
    with ProjectionRunner(log, Totals()) as runner:
        with pytest.raises(Truncated):
            runner.run_once()
        with pytest.raises(Truncated):
            runner.rebuild()
    assert [(r.consumer, r.position) for r in log.checkpoints(after="fast").collect()] == [("slow", 4)]


def test_export_chain(log):
    fill(log, 8)
    receipts, at = [], 0
    for _ in range(3):
        page, r = log.export_recorded(at, Filter(), 3)
        receipts.append(r)
        at = r.through
    assert [(r.from_position, r.through, r.count) for r in receipts] == [(0, 3, 3), (3, 6, 3), (6, 8, 2)]
    log.confirm_export(1)
    log.confirm_export(3)
    log.confirm_export(3)
    assert log.exported_through() == 3
    with pytest.raises(NotExported) as e:
        log.retain(Plan.before(8), Guard.EXPORTED)
    assert (e.value.up_to, e.value.exported_through) == (8, 3)
    with pytest.raises(Validation):
        log.confirm_export(9)
    log.confirm_export(log.export_recorded(3, Filter.of_kinds(["a"]), 9)[1].id)  # filtered: not whole
    assert log.exported_through() == 3
    log.confirm_export(2)
    assert log.exported_through() == 8 and log.export_receipts(limit=2).count() == 2


class Flaky(Sink):
    def __init__(self, fail_at):
        self.pages, self.fail_at = [], fail_at

    def write(self, page):
        if len(self.pages) == self.fail_at:
            self.fail_at = None
            raise OSError
        self.pages.append([e.position for e in page])


def test_archive_resumes(log):
    for i in range(5):
        fill(log, 1, "keep" if i % 2 == 0 else "drop")
    sink = Flaky(1)
    with pytest.raises(OSError):
        log.archive_then_retain(Plan.streams(["drop"]), sink, 2)
    assert log.head_position() == 5 and log.exported_through() == 2
    assert log.archive_then_retain(Plan.streams(["drop"]), sink, 2).removed == 2
    assert sink.pages == [[1, 2], [3, 4]] and [r.position for r in log.read_all()] == [1, 3, 5]
    assert [r.plan for r in log.retention_ledger().collect()] == ["archive-then-remove: streams:1"]
    with pytest.raises(Validation):
        log.archive_then_retain(Plan.before(1), sink, 0)
    assert [r.position for r in log.replay(0, page=1)] == [1, 3, 5]


def test_transfer_round_trip(log, spark):
    for s, n in (("a", 4), ("b", 3), ("c", 1)):
        fill(log, n, s, "noted")
    out = io.StringIO()
    JsonLinesSink(out).write(log.export())
    records = read_json_lines(out.getvalue().splitlines())
    assert sorted(r.record for r in log.export_frame().collect()) and len(records) == 8
    assert [e.to_json() for e in read_json_lines(r.record for r in log.export_frame().orderBy("position").collect())] == [e.to_json() for e in log.export()]
    with EventLog.open_in_memory(spark) as other:
        sink = LogSink(other)
        sink.write(records[:5])
        sink.write([])
        sink.write(records[5:])
        assert sink.imported == 8 and sink.reproduced_coordinates and other.export() == log.export()
        report = other.import_records(records[:2])
        assert (report.first, report.last, report.reproduced_coordinates) == (9, 10, False)
        with pytest.raises(Validation):
            other.import_records([records[0], ExportedEvent("a", None, {"kind": "x"})])
        assert other.head_position() == 10
    for bad in ([], {"stream": ""}, {"stream": "s"}, {"stream": "s", "position": -1, "event": {}}):
        with pytest.raises(Validation):
            ExportedEvent.from_json(bad)


def test_foreign_table_is_adopted(log, spark):
    old = spark.createDataFrame([(1, "cart-1", "added", 5), (2, "cart-1", "added", 6), (3, "cart-2", "paid", 7)], "id int, stream string, kind string, at bigint")
    report = log.import_frame(old.selectExpr("id", "stream", "at as epoch_ms", "kind", "1L as schema_version", "'{}' as meta", "'{}' as data"), ["id"])
    assert (report.imported, report.first, report.last) == (3, 1, 3) and log.stream("cart-1").len() == 2


def test_backup_and_reclaim(log, spark, tmp_path):
    for i in range(4):
        fill(log, 2, f"s{i}")
    log.checkpoint_save("c", 3)
    log.retain(Plan.before(2), Guard.FORCE)
    log.index_meta("tenant")
    assert log.reclaim(grace=0) >= 4 and len(log.manifest.refresh().segments) == 1
    log.backup_to(str(tmp_path / "copy"))
    with pytest.raises(Validation):
        log.backup_to(str(tmp_path / "copy"))
    copy = EventLog.open(spark, str(tmp_path / "copy"))
    assert copy.export() == log.export() and copy.checkpoint_load("c") == 3 and copy.removed_watermark() == 2
    assert copy.stream("s0").append({"kind": "a"})[0::2] == (3, 9)


def test_sql_door(log, spark):
    fill(log, 4)
    log.stream("t").append({"kind": "b", "meta": {"k": 1}})
    assert log.query("select count(*) as n from events") == [{"n": 5}]
    assert log.query("select position from events where stream = :s and kind <=> :k", {"s": "t", "k": "b"}) == [{"position": 5}]
    assert log.query("select json_extract(meta, '$.k') as k from events where position = ?", [5]) == [{"k": "1"}]
    assert log.query("with recursive t(n) as (select 1 union all select n + 1 from t where n < 5) select max(n) as n from t") == [{"n": 5}]
    assert log.stream("t").query("select stream, next_seq from stream_seq order by 1") == [{"stream": "s", "next_seq": 5}, {"stream": "t", "next_seq": 2}]
    assert log.query("describe events")[0]["col_name"] == "position"
    for sql in ("drop view events", "insert into events select * from events", "create temporary view events as select 1", "set spark.sql.ansi.enabled=false", "explain insert into events select * from events", "delete from events", "cache table events"):
        with pytest.raises(Unsupported):
            log.query(sql)
    for sql, params in (("select :a as a", {}), ("select :a as a", {"a": 1, "b": 2}), ("select ? as a", [1, 2]), ("select ? as a, :b as b", [1]), ("select ? as a", [2**63]), ("selec", None), ("select * from nowhere", None)):
        with pytest.raises(Validation):
            log.query(sql, params)
    with pytest.raises(Unsupported):
        log.query("select x'00ff' as a")
    assert log.query_with("select x'00ff' as a, double('inf') as b, double('-inf') as c, double('nan') as d", None, QueryOptions(lossy=True)) == [{"a": "00FF", "b": "Inf", "c": "-Inf", "d": "NaN"}]
    assert cell(1.5, False) == 1.5
    with pytest.raises(Timeout):
        log.query_timeout("select count(*) as n from range(100000000000) a where hash(id) = 7", None, 0.5)


def test_data_source(log, spark, tmp_path):
    spark.dataSource.register(EvlogSource)
    fill(log, 5)
    fill(log, 3, "t", "b")
    assert spark.read.format("evlog").option("path", log.manifest.root).option("from", "2").load().count() == 6
    got = []

    def run():
        q = stream_frame(spark, log.manifest.root, kinds='["a"]').writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, i: got.append(sorted(r.position for r in df.collect()))).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    fill(log, 2)
    run()
    assert [g for g in got if g] == [[1, 2, 3, 4, 5], [9, 10]]


def test_payload_is_never_traced(log, caplog):
    caplog.set_level(logging.DEBUG, "evlog")
    log.stream("s").append({"kind": "a", "meta": {"k": "geheim"}, "data": {"x": "geheim"}})
    log.query("select 'geheim' as a from events where kind = :k", {"k": "geheim"})
    with pytest.raises(Validation):
        log.query("select 'geheim', :k", {})
    assert caplog.records and "geheim" not in caplog.text + str([getattr(r, "fields", "") for r in caplog.records])
