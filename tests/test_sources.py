"""JSON Lines in bulk."""

import pytest

from evlog.log import EventLog
from evlog.sources.jsonl import read_records


def test_bulk_round_trip(log, spark, tmp_path):
    for i in range(6):
        log.stream("ab"[i % 2]).append({"kind": "noted", "meta": {"n": i, "ü": "x\"y"}, "data": {"deep": [{"k": None}]}})
    log.export_frame().orderBy("position").select("record").coalesce(1).write.text(str(tmp_path / "out"))
    with EventLog.open_in_memory(spark) as other:
        assert other.import_frame(read_records(spark, str(tmp_path / "out")), ["ord"]).imported == 6
        assert other.export() == log.export()
    (tmp_path / "bad.jsonl").write_text('{"stream":"s","event":{"kind":"a"}}\n')
    with pytest.raises(Exception, match="no record"):
        read_records(spark, str(tmp_path / "bad.jsonl")).collect()
