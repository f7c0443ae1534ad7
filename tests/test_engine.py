"""What the engine costs, and what it does while others write."""

import threading

import pytest

from evlog.errors import StorageError, Unsupported, Validation
from evlog.log import EventLog, OpenOptions
from evlog.operators.filters import Filter
from evlog.plans.queries import Totals, ev
from evlog.project import ProjectionRunner
from evlog.retention import Guard, Plan
from evlog.store import manifest


def test_small_segments_are_merged_in_tiers(log, monkeypatch):
    monkeypatch.setattr(manifest, "FAN", 4)
    for i in range(150):
        log.stream(f"s{i % 5}").append(ev("x", i=i))
    state = log.manifest.refresh()
    assert len(state.segments) < 20 and state.small == state.segments
    assert [r.position for r in log.read_all()] == list(range(1, 151)) and log.stream("s3").len() == 30
    assert [e["meta"]["i"] for e in log.stream("s3").read_last(3)] == [138, 143, 148]
    assert [e["seq"] for e in log.stream("s3").read(10, 4)] == [10, 11, 12, 13]
    other = EventLog.open(log.spark, log.database())
    assert other.manifest.state.small.keys() == state.small.keys() and other.head_position() == 150


def test_a_commit_copies_no_counters(log):
    log.stream("a").append(ev("x"))
    before = log.manifest.refresh()
    log.stream("b").append(ev("x"))
    after = log.manifest.refresh()
    assert before is not after and before.stream_seq is after.stream_seq and len(before.segments) == 1


def test_limited_reads_open_segments_from_their_end(log, monkeypatch):
    for i in range(8):
        log.append_frame(log.spark.range(750).selectExpr("concat('s', id % 3) as stream", f"{i} + id as epoch_ms", "'k' as kind", "1L as schema_version", "'{}' as meta", "'{}' as data", "id"), ["id"])
    opened = []
    check = log.manifest.check
    monkeypatch.setattr(log.manifest, "check", lambda s: opened.append(s) or check(s))
    assert [r.position for r in log.read_all(0, limit=5)] == [1, 2, 3, 4, 5]
    few = len({s.path for s in opened})
    opened.clear()
    assert [e["seq"] for e in log.stream("s1").read_last(2)] == [1999, 2000] and max(few, len({s.path for s in opened})) < len(log.manifest.state.segments) / 2


def test_bulk_append_lets_others_write(log, monkeypatch):
    rows = log.spark.range(50).selectExpr("'bulk' as stream", "id as epoch_ms", "'k' as kind", "1L as schema_version", "'{}' as meta", "'{}' as data", "id")
    numbered, wrote = log._numbered, []

    def slow(*args):
        if not wrote:
            thread = threading.Thread(target=lambda: wrote.append(log.stream("bulk").append(ev("x"))))
            thread.start()
            thread.join(20)
        return numbered(*args)

    monkeypatch.setattr(log, "_numbered", slow)
    assert log.append_frame(rows, ["id"]) == (50, 2, 51) and wrote[0].position == 1
    assert [e["seq"] for e in log.stream("bulk").read()] == list(range(1, 52))


def test_an_indexed_key_reaches_the_scan(log):
    log.stream("s").append_many([ev("x", k=i, t=f"v{i % 7}") for i in range(100)])
    log.index_meta("k")
    log.index_meta("t")
    assert log.scan(0, Filter().meta("k", 5)).count() == 1  # no segment has the column yet
    log.stream("s").append_many([ev("x", k=True, t="v1"), ev("x", k=5.0, t="5"), ev("x", k="5")])
    log.reclaim(grace=0)
    for f, n in ((Filter().meta("k", 5), 2), (Filter().meta("k", 1), 2), (Filter().meta("k", "5"), 1), (Filter().meta("t", "v1"), 16), (Filter().meta("t", 5), 0)):
        df = log.scan(0, f)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == n == len(log.read_all(0, f)) and "PushedFilters: [IsNotNull(_" in plan, f


def test_a_batch_costs_what_it_changes(log):
    with ProjectionRunner(log, Totals(), 10) as runner:
        for i in range(40):
            log.stream(f"s{i % 3}").append(ev("purchase", {"value": i}))
        assert [runner.run_once() for _ in range(5)] == [10, 10, 10, 10, 0]
        entry = log.manifest.state.models["totals"].split("|")
        assert len(entry) == 5 and all(p.endswith("@stream") for p in entry[1:])
        assert sorted(map(tuple, runner.model().collect())) == [("s0", 27300, 14, 40), ("s1", 24700, 13, 38), ("s2", 26000, 13, 39)]
        for i in range(20):
            log.stream("s0").append(ev("purchase", {"value": 1}))
            runner.run_once()
        assert log.manifest.state.models["totals"].count("|") <= 16
        log.reclaim(grace=0)
        assert runner.model().where("stream = 's0'").first().n == 34


def test_a_failed_commit_makes_the_runner_unusable(log, monkeypatch):
    log.stream("s").append(ev("purchase", {"value": 1}))
    runner = ProjectionRunner(log, Totals())

    def broken(_):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(log.manifest, "publish", broken)
        with pytest.raises(StorageError):
            runner.run_once()
    with pytest.raises(StorageError):
        runner.run_once()
    assert runner.into_inner().name == "totals" and ProjectionRunner(log, Totals()).catch_up() == 1


def test_transactions_run_statements_on_caller_tables(log):
    with log.transaction() as t:
        t.execute("create table if not exists notes (id bigint, text string, at double)")
        t.execute("insert into notes (text, id) values (?, 1), ('b', 2)", ["a"])
        t.execute("insert into notes select position, kind, 0.5 from events")
        t.execute("update notes set text = concat(text, '!'), at = id / 2 where id = 2")
        t.execute("delete from notes where at is null and id = 1")
        for bad in ("insert into nowhere values (1)", "update notes set nothing = 1", "insert into notes values (1)", "insert into notes select id, name, 1 from parquet.`/tmp`", "drop table events", "truncate table notes", "create table notes (id bigint)"):
            with pytest.raises((Unsupported, Validation)):
                t.execute(bad)
    assert log.query("select * from notes") == [{"id": 2, "text": "b!", "at": 1.0}]
    with log.transaction() as t:
        t.execute("drop table notes")
    with pytest.raises(Validation):
        log.query("select * from notes")


def test_unique_keys_are_asked_in_their_own_column(spark, tmp_path):
    log = EventLog.open(spark, str(tmp_path / "log"), OpenOptions(unique_meta=("id",)))
    log.append_frame(spark.range(30).selectExpr("'s' as stream", "id as epoch_ms", "'k' as kind", "1L as schema_version", "concat('{\"id\":', id, '}') as meta", "'{}' as data", "id"), ["id"])
    assert all(s.keys == ["id"] for s in log.manifest.state.segments.values())
    with pytest.raises(Validation):
        log.stream("s").append(ev("x", id=7))
    assert log.stream("s").append(ev("x", id="7")).position == 31


def test_retention_keeps_names_of_streams(log):
    log.append_frame(log.spark.range(90).selectExpr("concat('s', id % 3) as stream", "id as epoch_ms", "'k' as kind", "1L as schema_version", "'{}' as meta", "'{}' as data", "id"), ["id"])
    log.retain(Plan.before(10), Guard.FORCE)
    log.reclaim(grace=0)
    assert all(s.streams == ["s0", "s1", "s2"] and s.kinds == ["k"] for s in log.manifest.state.segments.values())
    assert log.retain(Plan.streams(["s0", "s1", "s2"]), Guard.FORCE).removed == 80 and log.head_position() == 0


def test_reclaim_leaves_files_to_their_readers(log):
    for _ in range(3):
        log.stream("s").append(ev("x"))
    held = log.scan()
    assert log.reclaim() == 0 and held.count() == 3 and log.reclaim(grace=0) == 3


def _rows_of(log, n, kinds=5):
    return log.spark.range(n).selectExpr("concat('s', id % 3) as stream", "id as epoch_ms", f"concat('k', id % {kinds}) as kind", "1L as schema_version", "concat('{\"n\":', id, '}') as meta", "'{}' as data", "id")


def test_a_replay_reads_on_from_page_to_page(log, monkeypatch):
    log.append_frame(_rows_of(log, 3000), ["id"])
    monkeypatch.setattr("evlog.log.DRIVER_ROWS", 100)
    monkeypatch.setattr(log, "stored", lambda *a, **k: pytest.fail("a job for a page"))
    opened, check = [], log.manifest.check
    monkeypatch.setattr(log.manifest, "check", lambda s: opened.append(s.path) or check(s))
    assert [r.position for r in log.replay(300, Filter.of_kinds(["k1"]), 16)] == list(range(302, 3001, 5))
    assert len(opened) == len(set(opened))
    for size in (1, 6, 7, 540, 541):  # of 540 rows
        assert len(list(log.replay(300, Filter.of_kinds(["k1"]), size))) == 540
    assert list(log.replay(0, Filter.of_kinds([]))) == list(log.replay(3000)) == []


def test_a_replay_sees_commits_between_its_pages(log, monkeypatch):
    log.stream("a").append_many([ev("x")] * 5)
    log.append_frame(_rows_of(log, 40, 1), ["id"])
    log.stream("a").append_many([ev("x")] * 5)
    got = []
    for r in log.replay(0, page=10):
        got.append(r.position)
        if len(got) == 5:  # small segments of both ends become one that overlaps the others
            log.reclaim(small_rows=6, grace=0)
        if len(got) == 20:
            log.retain(Plan.before(33), Guard.FORCE)
            log.stream("a").append(ev("late"))
    assert got == [*range(1, 21), *range(34, 52)]
    assert [r.position for r in log.read_all(35, Filter().stream("a"), 4)] == [46, 47, 48, 49]


def test_a_limited_read_that_skips_many_rows_is_finished_by_a_job(log, monkeypatch):
    log.append_frame(_rows_of(log, 900), ["id"])
    whole = {f: [r.position for r in log.read_all(10, f)] for f in (Filter().meta("n", 880), Filter.of_kinds(["k3"]), Filter.of_kinds(["k3"]).stream_prefix("s1"), Filter().stream("s2").meta("n", 500))}
    monkeypatch.setattr("evlog.log.DRIVER_ROWS", 50)
    jobs, stored = [], log.stored
    monkeypatch.setattr(log, "stored", lambda *a, **k: jobs.append(a) or stored(*a, **k))
    for f, want in whole.items():
        for n in (1, 5, 40, 1000):
            assert [r.position for r in log.read_all(10, f, n)] == want[:n]
    jobs.clear()
    assert [r.position for r in log.read_all(400, Filter.of_kinds(["k3"]), 5)] == [404, 409, 414, 419, 424] and not jobs


def test_a_rewrite_is_cut_into_slices_of_rows(log, monkeypatch):
    log.append_frame(_rows_of(log, 900), ["id"])
    monkeypatch.setattr("evlog.retention.SLICE_ROWS", 150, raising=False)
    before = {r.position: r for r in log.scan().collect()}
    assert log.retain(Plan.streams(["s2"]), Guard.FORCE).removed == 300
    kept = sorted(log.manifest.state.segments.values(), key=lambda s: s.min_position)
    assert len(kept) == 6 and max(s.rows for s in kept) <= 150 and all(a.max_position < b.min_position for a, b in zip(kept, kept[1:], strict=False))
    assert {r.position: r for r in log.scan().collect()} == {p: r for p, r in before.items() if r.stream != "s2"}
    log.index_meta("n")
    log.reclaim(small_rows=140, grace=0)
    after = set(log.manifest.state.segments)
    assert len(after) == 4 and sum(s.rows for s in log.manifest.state.segments.values()) == 600
    assert [r.position for r in log.read_all(0, Filter().meta("n", 888))] == [889] == [r.position for r in log.scan(0, Filter().meta("n", 888)).collect()]
    assert log.reclaim(small_rows=140, grace=0) == 0 and set(log.manifest.state.segments) == after  # slices aren't merged again


def test_bulk_numbers_need_no_window_over_a_whole_partition(log, tmp_path):
    from evlog.plans import coordinates

    path = str(tmp_path / "staged")
    coordinates.ordered(_rows_of(log, 700), ["id"], 5).write.parquet(path)
    out = coordinates.assign(log.spark.read.parquet(path), 40, None)
    windows = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [w for w in windows if "row_number" in w and "windowspecdefinition(_p#" in w and "stream#" not in w.split("windowspecdefinition(")[1].split(" ASC")[0]]
    rows = out.orderBy("id").collect()
    assert [r.position for r in rows] == list(range(41, 741)) and [r.seq for r in rows] == [i // 3 + 1 for i in range(700)]
