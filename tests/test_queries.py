"""Every registered query of the log against its DuckDB SQL, and the plans that matter."""

import os

import pytest

from evlog.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def _values(rows):
    return sorted(str([f"{x:.9g}" if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "orders", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = plans.QUERIES[name](spark, SF)
    want = con.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert _values(got.select(*names).collect()) == _values(want.fetchall())


def test_filters_reach_the_scan(spark):
    from evlog.operators.filters import Filter

    log = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id as position", "event_type as kind", "props as meta", "cast(user_id as string) as stream")
    plan = log.where(Filter.of_kinds(["click"]).column()).where("position > 7").select("position")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type, [click])" in plan or "EqualTo(event_type,click)" in plan
    assert "GreaterThan(event_id,7)" in plan and "props" not in plan.split("ReadSchema")[1]


def test_entry_imports_without_the_subpackage():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if 'llm' in n or 'corpus' in n else f(n, *a); import __spark_entry__ as e; assert not any(q.startswith('op') for q in e.queries()) and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
