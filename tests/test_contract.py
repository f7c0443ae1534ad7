"""Envelope, filters, prefixes, upcasting and the memory stream: no Spark job needed."""

import pytest

from evlog import envelope
from evlog.errors import Corruption, HeadMismatch, Validation
from evlog.functions.prefix import stream_prefix_bound
from evlog.memory import MemoryStream
from evlog.operators.filters import MAX_MEMBERS, Filter
from evlog.operators.upcast import Upcaster, apply_chain
from evlog.retention import chain_reach
from evlog.schema import check_u63


@pytest.mark.parametrize("bad", [{}, {"kind": ""}, {"kind": "a", "seq": 1}, {"kind": "a", "x": 1}, {"kind": "a", "data": []}, {"kind": "a", "meta": {"k": None}}, {"kind": "a", "meta": {"k": [1]}}, {"kind": "a", "_schema_version": -1}, {"kind": "a", "data": {"x": float("nan")}}])
def test_new_events_that_are_refused(bad):
    with pytest.raises(Validation):
        envelope.validate(bad)


def test_stamp_fills_in_and_restamp_keeps():
    e = envelope.stamp({"kind": "a"}, 3, 7)
    assert e == {"kind": "a", "meta": {}, "data": {}, "_schema_version": 1, "seq": 3, "epoch_ms": 7}
    assert envelope.restamp(e | {"_schema_version": 4}, 9) == e | {"_schema_version": 4, "seq": 9}
    with pytest.raises(Validation):
        envelope.validate_stored({"kind": "a"})


def test_stored_text_that_is_no_object_is_corruption():
    row = envelope.to_row(1, "s", envelope.stamp({"kind": "a"}, 1, 1))
    assert envelope.from_row(row)["kind"] == "a"
    for text in ("[]", "{", None):
        with pytest.raises(Corruption):
            envelope.from_row(row | {"meta": text})


@pytest.mark.parametrize(("prefix", "bound"), [("session-", "session."), ("a", "b"), ("퟿", ""), ("a\U0010ffff", "b"), ("\U0010ffff", None), ("", None)])
def test_prefix_bound(prefix, bound):
    assert stream_prefix_bound(prefix) == bound


def test_filter_axes():
    f = Filter().streams(["a", "b"]).stream("c")
    assert f.matches("c", "k", {}) and not f.matches("a", "k", {})
    assert Filter.of_kinds([]).selects_nothing and not Filter().stream_prefix("").selects_nothing
    assert Filter().stream_prefix("").whole and not Filter.of_kinds(["x"]).whole
    for v in (None, [1], {}):
        with pytest.raises(Validation):
            Filter().meta("k", v).validate()
    for k in ("", 'a"b'):
        with pytest.raises(Validation):
            Filter().meta(k, 1).validate()
    with pytest.raises(Validation):
        Filter.of_kinds(map(str, range(MAX_MEMBERS + 1))).validate()


def test_positions_out_of_range_are_refused():
    for v in (-1, 2**63, True, 1.0):
        with pytest.raises(Validation):
            check_u63(v, "position")


def test_upcast_selects_on_kind_and_version():
    def step(e):
        return e | {"data": e["data"] | {"total": 0}, "_schema_version": 2} if (e["kind"], e["_schema_version"]) == ("order_placed", 1) else e

    s = MemoryStream([Upcaster(step)])
    s.append_many([{"kind": "order_placed"}, {"kind": "note_written"}, {"kind": "order_placed", "_schema_version": 2}])
    assert [e["_schema_version"] for e in s.read()] == [2, 1, 2]
    assert ["total" in e["data"] for e in s.read()] == [True, False, False]
    with pytest.raises(Corruption):
        apply_chain([Upcaster(lambda e: {k: v for k, v in e.items() if k != "kind"})], s.events[0])


def test_memory_stream():
    s = MemoryStream()
    assert s.is_empty() and s.head() is None
    with pytest.raises(Validation):
        s.append_many([{"kind": "a"}, {"kind": ""}])
    assert s.len() == 0
    assert s.append({"kind": "a"}).seq == 1 and s.append_at(5, {"kind": "b"}).epoch_ms == 5
    assert s.append_if(["a"], lambda seen: {"kind": "c"} if len(seen) == 1 else None).seq == 3
    assert s.append_if(None, lambda seen: None) is None
    with pytest.raises(HeadMismatch):
        s.append_expecting(None, {"kind": "d"})
    assert s.append_expecting(3, {"kind": "d"}).seq == 4
    assert [e["kind"] for e in s.read_last(2)] == ["c", "d"]


def test_chain_reach():
    assert chain_reach([]) == 0
    assert chain_reach([(0, 3), (6, 8)]) == 3
    assert chain_reach([(3, 6), (0, 3), (5, 8)]) == 8
