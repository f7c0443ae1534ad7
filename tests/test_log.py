"""Writing and reading a log: coordinates, filters, decisions, transactions."""

import subprocess
import sys
import threading

import pytest

from evlog.errors import Corruption, HeadMismatch, StorageError, Validation
from evlog.log import EventLog, OpenOptions
from evlog.operators.filters import Filter
from evlog.operators.upcast import Upcaster


def ev(kind, **meta):
    return {"kind": kind, "meta": meta}


def at(rows):
    return [r.position for r in rows]


def test_seq_counts_by_stream_and_position_over_the_log(log):
    got = [log.stream(s).append(ev("x")) for s in "aba"]
    assert [(c.seq, c.position) for c in got] == [(1, 1), (1, 2), (2, 3)]
    assert log.head_position() == 3 and log.stream("a").head() == 2 and log.stream("a").len() == 2
    assert log.stream("none").is_empty()


def test_meta_axis(log, spark):
    for s, k, m in [("orders/17", "placed", {"tenant": "a"}), ("orders/17", "paid", {"tenant": "a"}), ("orders/18", "placed", {"tenant": "b"}), ("orders/17", "closed", {"tenant": "a", "closed": True}), ("orders/19", "placed", {"tenant": "a", "total": 40}), ("s", "x", {"order.id": "o-1", "one": 1, "half": 0.5})]:
        log.stream(s).append(ev(k, **m))
    cases = [
        (Filter().meta("tenant", "a"), [1, 2, 4, 5]), (Filter().meta("closed", True), [4]), (Filter().meta("closed", False), []), (Filter().meta("total", 40), [5]),
        (Filter().meta("total", 40.0), [5]), (Filter().meta("total", "40"), []), (Filter.of_kinds(["placed"]).meta("tenant", "a"), [1, 5]), (Filter().meta("tenant", "a").meta("tenant", "b"), []),
        (Filter().meta("order.id", "o-1"), [6]), (Filter().meta("one", True), [6]), (Filter().meta("closed", 1), [4]), (Filter().meta("half", 0.5), [6]), (Filter().stream("orders/17").meta("tenant", "a"), [1, 2, 4]),
    ]
    for f, want in cases:
        assert at(log.read_all(0, f)) == want
        assert [r.position for r in log.scan(0, f).orderBy("position").collect()] == want
    with pytest.raises(Validation):
        log.read_all(0, Filter().meta("tenant", None))
    assert log.read_all(0, Filter.of_kinds([]).meta("tenant", None)) == []


def test_prefix_axis(log):
    for s in ["session-2026-09-01", "order-1", "session-2026-09-02", "sessions-x", "session-2026-09-01", "sessio", "session-2026-09-03", "session-2026-09-02"]:
        log.stream(s).append(ev("x"))
    for f, want in [(Filter().stream_prefix("session-"), [1, 3, 5, 7, 8]), (Filter().stream_prefix("sessions"), [4]), (Filter().stream_prefix("nothing-"), []), (Filter().streams(["session-2026-09-01", "order-1"]).stream_prefix("session-"), [1, 5]), (Filter().stream_prefix(""), list(range(1, 9)))]:
        assert at(log.read_all(0, f)) == want == [r.position for r in log.scan(0, f).orderBy("position").collect()]


def test_pages_neither_skip_nor_repeat(log):
    log.stream("s").append_many([ev("x")] * 7)
    assert at(log.read_all(3, limit=2)) == [4, 5] and log.read_all(0, limit=0) == []
    assert at(log.replay(0, page=3)) == [1, 2, 3, 4, 5, 6, 7]
    assert [e["seq"] for e in log.stream("s").read(3, 2)] == [3, 4] and [e["seq"] for e in log.stream("s").read_last(2)] == [6, 7]
    with pytest.raises(Validation):
        log.read_all(2**63)


def test_rejected_batches_leave_nothing(log):
    log.stream("s").append(ev("x"))
    with pytest.raises(Validation):
        log.stream("s").append_many([ev("x"), {"kind": ""}])
    with pytest.raises(ZeroDivisionError), log.transaction() as t:
        t.append("s", ev("x"))
        raise ZeroDivisionError
    assert log.stream("s").append(ev("x"))[0::2] == (2, 2)
    assert log.stream("s").append_many([]) == []


def test_decisions(log):
    acc = log.stream("acc")
    acc.append({"kind": "granted", "data": {"amount": 10}})

    def spend(n):
        def decide(seen):
            left = sum(e["data"]["amount"] * (1 if e["kind"] == "granted" else -1) for e in seen)
            return {"kind": "spent", "data": {"amount": n}} if n <= left else None

        return decide

    assert acc.append_if(None, spend(4)).seq == 2 and acc.append_if(["granted", "spent"], spend(100)) is None and acc.len() == 2


def test_expected_version(log):
    s = log.stream("s")
    assert s.append_expecting(None, ev("x")).seq == 1
    with pytest.raises(HeadMismatch) as e:
        s.append_expecting(None, ev("x"))
    assert (e.value.expected, e.value.actual) == (None, 1)
    assert s.append_expecting(1, ev("x")).seq == 2


def test_transaction_reads_its_own_writes_and_commits_tables(log, spark):
    log.stream("s").append(ev("x"))
    with log.transaction() as t:
        t.append_many("s", [ev("y"), ev("x")])
        assert [e["kind"] for e in t.read("s")] == ["x", "y", "x"] and t.head("s") == 3
        assert [e["seq"] for e in t.read("s", ["x"])] == [1, 3]
        t.put_table("mine", spark.createDataFrame([(1, "a")], "id int, v string"))
    with log.transaction() as t:
        t.upsert_table("mine", spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string"), ["id"])
    assert log.query("select id, v from mine order by id") == [{"id": 1, "v": "b"}, {"id": 2, "v": "c"}]
    with pytest.raises(ZeroDivisionError), log.transaction() as t:
        t.drop_table("mine")
        raise ZeroDivisionError
    assert len(log.query("select * from mine")) == 2


def test_concurrent_writers_leave_no_gap(log):
    def work(i):
        for k in range(5):
            log.stream(f"w{i}").append({"kind": "tick", "data": {"i": k}})

    threads = [threading.Thread(target=work, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert at(log.read_all()) == list(range(1, 31))
    assert all([e["seq"] for e in log.stream(f"w{i}").read()] == [1, 2, 3, 4, 5] for i in range(6))


def test_two_processes_on_one_log(spark, tmp_path):
    log = EventLog.open(spark, str(tmp_path / "log"))
    code = f"from evlog.log import *; l = EventLog.open(None, {str(tmp_path / 'log')!r}); [l.stream('p').append({{'kind': 't'}}) for _ in range(20)]"
    other = subprocess.Popen([sys.executable, "-c", code])
    for _ in range(20):
        log.stream("q").append(ev("t"))
    assert other.wait() == 0
    assert at(log.read_all()) == list(range(1, 41)) and log.stream("p").len() == 20
    assert EventLog.open(spark, str(tmp_path / "log")).database() == log.database()


def test_detached_appends_are_drained(log):
    for i in range(5):
        log.stream("d").detach_append(ev("x", i=i))
    with pytest.raises(Validation):
        log.stream("d").detach_append({"kind": ""})
    log.shutdown()
    log.shutdown()
    assert [e["meta"]["i"] for e in log.stream("d").read()] == [0, 1, 2, 3, 4]
    with pytest.raises(StorageError):
        log.detach_append("d", ev("x"))


def test_bulk_append_numbers_like_single_ones(log, spark):
    log.stream("b").append(ev("x"))
    rows = [(i, "abc"[i % 3], 1000 + i, "k", None, '{"n": %d}' % i, None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, stream string, epoch_ms bigint, kind string, schema_version bigint, meta string, data string")
    assert log.append_frame(df, ["i"]) == (200, 2, 201)
    got = log.read_all(1)
    assert at(got) == list(range(2, 202)) and [r.event["meta"]["n"] for r in got] == list(range(200))
    assert [e["seq"] for e in log.stream("b").read()] == list(range(1, 69))
    assert log.stream("a").append(ev("x"))[0::2] == (68, 202)
    assert [(r.stream, r.head_seq) for r in log.streams().collect()] == [("a", 68), ("b", 68), ("c", 66)]
    with pytest.raises(Validation):
        log.append_frame(df.withColumn("meta", df.kind), ["i"])
    assert log.head_position() == 202


def test_upcast_after_filter(spark):
    step = Upcaster(lambda e: e | {"kind": "new"} if e["kind"] == "old" else e)
    with EventLog.open_in_memory(spark, OpenOptions(upcasters=[step])) as log:
        log.stream("s").append_many([ev("old"), ev("new")])
        assert [r.kind for r in log.read_all(0, Filter.of_kinds(["old"]))] == ["new"]
        assert [r.kind for r in log.scan(0, Filter.of_kinds(["old"])).collect()] == ["new"]
        assert [e.event["kind"] for e in log.export()] == ["old", "new"]


def test_unique_meta(spark):
    with EventLog.open_in_memory(spark, OpenOptions(unique_meta=("event_id",))) as log:
        log.stream("s").append_many([ev("x", event_id="01H0"), ev("x", event_id="01H1")])
        with pytest.raises(Validation):
            log.stream("s").append_many([ev("x", event_id="01H1"), ev("x", event_id="01H2")])
        assert log.stream("s").len() == 2


def test_subscription_sees_later_writes(log):
    log.stream("s").append(ev("x"))
    got, stop = [], threading.Event()

    def run():
        for r in log.subscribe(stop=stop):
            got.append(r.position)
            if len(got) == 3:
                stop.set()

    t = threading.Thread(target=run)
    t.start()
    log.stream("s").append_many([ev("x"), ev("x")])
    t.join(10)
    assert got == [1, 2, 3]


def test_damaged_segments_are_found(spark, tmp_path):
    import os

    log = EventLog.open(spark, str(tmp_path / "l"))
    log.stream("s").append(ev("x"))
    path = log.manifest.path(next(iter(log.manifest.state.segments)))
    os.chmod(path, 0o644)
    open(path, "ab").write(b"x")
    with pytest.raises(Corruption):
        log.read_all()
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "f").write_text("x")
    with pytest.raises(Validation):
        EventLog.open(spark, str(tmp_path / "other"))
