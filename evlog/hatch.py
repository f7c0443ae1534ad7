"""The read-only SQL door: Spark SQL over the log, its read models and the caller's tables."""

from __future__ import annotations

import copy
import math
import re
import threading
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog import trace
from evlog.errors import Timeout, Unsupported, Validation
from evlog.functions import json_meta
from evlog.schema import I64_MAX
from evlog.store.models import model_frame

#: Plan nodes that only read, by name: fixed values of Spark. Anything else is refused.
COMMANDS = frozenset("ExplainCommand DescribeRelation DescribeTableCommand ShowTables ShowTablesCommand ShowColumns ShowFunctions ShowFunctionsCommand DescribeFunctionCommand DescribeFunction ShowViews ShowViewsCommand".split())
READS = frozenset(
    "Project Filter Aggregate Sort Distinct Deduplicate Union Intersect Except Join LateralJoin AsOfJoin SubqueryAlias UnresolvedWith UnionLoop UnresolvedRelation UnresolvedInlineTable OneRowRelation LocalRelation "
    "UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedHint UnresolvedTableOrView UnresolvedNamespace CurrentNamespace UnresolvedFunctionName UnresolvedOrdinal GlobalLimit LocalLimit Limit Offset Tail Sample Generate Window "
    "WithWindowDefinition Pivot Unpivot UnresolvedPivot Expand Range Values PipeOperator".split()
)
#: Table-valued functions that compute from their arguments. Fixed values of Spark.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split())
_REACHING_OUT = re.compile(r"\b(java_method|reflect|try_reflect|input_file_name|input_file_block_start|input_file_block_length)\s*\(", re.I)
#: Levels of a recursive query.
RECURSION = 100_000


@dataclass(frozen=True)
class QueryOptions:
    timeout: float | None = None
    lossy: bool = False


def bind_value(value: Any) -> Any:
    """Parameters are scalars; arrays and objects go as JSON text."""
    import json

    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        if not -(2**63) <= value <= I64_MAX:
            raise Validation("an integer parameter has 64 bits")
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise Validation("a parameter is a finite number")
        return value
    if isinstance(value, list | dict):
        return json.dumps(value, ensure_ascii=False)
    raise Validation(f"a parameter can't be a {type(value).__name__}")


def _bare(sql: str) -> str:
    """The statement without strings, quoted names and comments."""
    return re.sub(r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", " ", sql, flags=re.S)


def bind(sql: str, params: Sequence[Any] | Mapping[str, Any] | None) -> list[Any] | dict[str, Any]:
    """Every declared parameter must be given, and no other; positional and named don't mix."""
    bare = _bare(sql)
    named, marks = set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", bare)), bare.count("?")
    if re.search(r"\?\d|[@$][A-Za-z_]", bare):
        raise Unsupported("parameters are ? or :name")
    if named and marks:
        raise Validation("positional and named parameters don't mix")
    if isinstance(params, Mapping):
        given = {k.removeprefix(":"): bind_value(v) for k, v in params.items()}
        if marks or set(given) != named:
            raise Validation(f"the statement takes {sorted(named) or marks}, not {sorted(given)}")
        return given
    values = [bind_value(v) for v in params or ()]
    if named or len(values) != marks:
        raise Validation(f"the statement takes {sorted(named) or marks} parameters, not {len(values)}")
    return values


def cell(value: Any, lossy: bool) -> Any:
    """A result cell as JSON: binary and non-finite numbers have none, unless loss is accepted."""
    if isinstance(value, bytes | bytearray):
        if not lossy:
            raise Unsupported("a binary value has no JSON form")
        return bytes(value).hex().upper()
    if isinstance(value, float) and not math.isfinite(value):
        if not lossy:
            raise Unsupported("a non-finite number has no JSON form")
        return "NaN" if math.isnan(value) else "Inf" if value > 0 else "-Inf"
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, list):
        return [cell(v, lossy) for v in value]
    if isinstance(value, dict):
        return {k: cell(v, lossy) for k, v in value.items()}
    if value is None or isinstance(value, str | int | float):
        return value
    if hasattr(value, "asDict"):
        return {k: cell(v, lossy) for k, v in value.asDict().items()}
    return str(value)


def _each(group) -> list:
    out, it = [], group.iterator()
    while it.hasNext():
        out.append(it.next())
    return out


def _types(cls) -> list[str]:
    out, todo = [], [cls]
    while todo:
        c = todo.pop()
        if c is not None:
            out.append(c.getName())
            todo += [c.getSuperclass(), *c.getInterfaces()]
    return out


def parse(spark: SparkSession, sql: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Validation(f"the statement can't be parsed: {trace.clip(str(e).splitlines()[0])}") from e


def authorize(plan, sql: str, known: set[str]) -> None:
    """Every node of the parsed plan only reads, and every relation it names is one of ``known`` or of the statement's own."""
    nodes, names, own, todo = [], [], set(), [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName().rstrip("$")
        nodes.append((name, node))
        if name == "ExplainCommand":
            todo.append(node.logicalPlan())
        if name == "UnresolvedWith":
            own |= {r._1().lower() for r in _each(node.cteRelations())}
        if name in ("UnresolvedRelation", "UnresolvedTableOrView"):
            names.append([p.lower() for p in _each(node.multipartIdentifier())])
        elif name == "UnresolvedTableValuedFunction" and [p.lower() for p in _each(node.name())][-1] not in TABLE_FUNCTIONS:
            raise Unsupported("the door has no such table function")
        for child in (*_each(node.children()), *_each(node.innerChildren())):
            if any(c.endswith(".LogicalPlan") for c in _types(child.getClass())):
                todo.append(child)
    for name, _ in nodes:
        if name not in READS and name not in COMMANDS:
            raise Unsupported(f"the door is read-only: {name}")
    for parts in names:
        if len(parts) == 1 and parts[0] not in known | own:
            raise Validation(f"there is no table {parts[0]}")
        if len(parts) != 1:
            raise Unsupported(f"the door reads the log, its models and the caller's tables, not {'.'.join(parts)}")
    if _REACHING_OUT.search(_bare(sql.replace("`", ""))):
        raise Unsupported("the door runs no function that reaches out of the statement")


#: Statements of a transaction on caller tables.
_DDL = re.compile(r"\s*create\s+table\s+(if\s+not\s+exists\s+)?(\w+)\s*\((.*)\)\s*;?\s*", re.I | re.S)
_DROP = re.compile(r"\s*drop\s+table\s+(if\s+exists\s+)?(\w+)\s*;?\s*", re.I)
_INSERT = re.compile(r"\s*insert\s+into\s+(?:table\s+)?(\w+)\s*(?:\(([\w\s,]+)\))?\s*((?:values|select|with|from|table)\b.*)", re.I | re.S)


def execute(txn, sql: str, params: Any = None) -> None:
    """One statement of data definition or manipulation; the table's new version becomes visible with the commit."""
    log = txn.log

    def table(name: str) -> DataFrame:
        found = txn.table(name.lower())
        if found is None:
            raise Unsupported(f"{name} is not the caller's table")
        return found

    def condition(node) -> Column:
        found = node.condition()  # an expression, or an option of one
        if found.getClass().getName().startswith("scala."):
            if not found.isDefined():
                return F.lit(True)
            found = found.get()
        return F.coalesce(F.expr(found.sql()), F.lit(False))

    if _REACHING_OUT.search(_bare(sql.replace("`", ""))):
        raise Unsupported("a transaction runs no function that reaches out of the statement")
    if m := _DDL.fullmatch(sql):
        if txn.table(m[2].lower()) is not None:
            if m[1]:
                return
            raise Validation(f"{m[2]} is there already")
        txn.put_table(m[2].lower(), log.spark.createDataFrame([], m[3]))
    elif m := _DROP.fullmatch(sql):
        if not m[1]:
            table(m[2])
        txn.drop_table(m[2].lower())
    elif m := _INSERT.fullmatch(sql):
        old = table(m[1])
        args = bind(m[3], params)
        door = log._door(txn.state, txn.tables())
        authorize(parse(door, m[3]), m[3], log._names(txn.state, txn.tables()))
        new = door.sql(m[3], args or None)
        columns = [c.strip().lower() for c in m[2].split(",")] if m[2] else [c.lower() for c in old.columns]
        if len(columns) != len(new.columns) or not set(columns) <= {c.lower() for c in old.columns}:
            raise Validation("the columns don't match the table's")
        new = new.toDF(*columns).collect()  # of the door's session: a statement's rows, as the log's own appends are
        schema = {f.name.lower(): f for f in old.schema.fields}
        rows = log.spark.createDataFrame([tuple(r) for r in new], door.createDataFrame([], ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in columns)).schema) if new else old.select(*columns).limit(0)
        full = rows.select(*[F.col(f.name).cast(f.dataType) if f.name.lower() in columns else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema.fields])
        txn.put_table(m[1].lower(), old.unionByName(full))
    else:
        if params:
            raise Unsupported("UPDATE and DELETE take no parameters")
        node = parse(log.spark, sql)
        kind = node.getClass().getSimpleName()
        if kind not in ("DeleteFromTable", "UpdateTable"):
            raise Unsupported(f"a transaction runs no {kind}")
        target = node.table()
        while target.getClass().getSimpleName() == "SubqueryAlias":
            target = target.child()
        (name,) = _each(target.multipartIdentifier())
        old, hit = table(name), condition(node)
        if kind == "DeleteFromTable":
            txn.put_table(name.lower(), old.where(~hit))
        else:
            sets = {a.key().sql().strip("`").lower(): a.value().sql() for a in _each(node.assignments())}
            if not set(sets) <= {c.lower() for c in old.columns}:
                raise Validation("the columns don't match the table's")
            txn.put_table(name.lower(), old.select(*[F.when(hit, F.expr(sets[f.name.lower()])).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name.lower() in sets else F.col(f.name) for f in old.schema.fields]))


class QueryDoor:
    """Part of ``EventLog``. Statements run in a session of their own, which has the log's views only."""

    _opened: tuple[SparkSession, Any] | None = None

    def _names(self, state, tables: Mapping[str, str | None]) -> set[str]:
        return {"events", "stream_seq", "checkpoints", "retention", "exports", *(n.lower() for n in state.models), *(n.lower() for n, p in tables.items() if p)}

    def _door(self, state, tables: Mapping[str, str | None]) -> SparkSession:
        """The door's session with the state, its read models and caller tables as temporary views."""
        if self._opened is None:
            session = self.spark.newSession()
            session.conf.set("spark.sql.cteRecursionLevelLimit", str(RECURSION))
            json_meta.register(session)
            self._opened = (session, None)
        session, had = self._opened
        if had == (now := (state.n, tuple(sorted(tables.items(), key=str)))):
            return session
        own = copy.copy(self)
        own.spark = session
        own._frame(state).createOrReplaceTempView("events")
        own._streams(state).selectExpr("stream", "head_seq + 1 as next_seq").createOrReplaceTempView("stream_seq")
        for name, df in (("checkpoints", own.checkpoints()), ("retention", own.retention_ledger()), ("exports", own.export_receipts())):
            df.createOrReplaceTempView(name)
        for name, path in state.models.items():
            if path:
                model_frame(session, self.manifest, path).createOrReplaceTempView(name)
        for name, path in tables.items():
            if path:
                session.read.parquet(self.manifest.path(path)).createOrReplaceTempView(name)
            else:
                session.catalog.dropTempView(name)
        self._opened = (session, now)
        return session

    def query(self, sql: str, params: Sequence[Any] | Mapping[str, Any] | None = None) -> list[dict[str, Any]]:
        return self.query_with(sql, params, QueryOptions())

    def query_timeout(self, sql: str, params: Sequence[Any] | Mapping[str, Any] | None, seconds: float) -> list[dict[str, Any]]:
        return self.query_with(sql, params, QueryOptions(timeout=seconds))

    def query_frame(self, sql: str, params: Sequence[Any] | Mapping[str, Any] | None = None) -> DataFrame:
        """The same as a frame of the door's session: for results that don't belong on the driver."""
        with trace.span("hatch", sql=trace.clip(_bare(sql))):
            state = self.manifest.refresh()
            authorize(parse(self.spark, sql), sql, self._names(state, state.tables))
            args = bind(sql, params)
            try:
                return self._door(state, state.tables).sql(sql, args or None)
            except PySparkException as e:
                raise Validation(trace.clip(str(e))) from e

    def query_with(self, sql: str, params: Sequence[Any] | Mapping[str, Any] | None, options: QueryOptions) -> list[dict[str, Any]]:
        """Rows as JSON objects, of stored shapes. They are the caller's to bound; ``query_frame`` leaves them distributed."""
        return [{k: cell(v, options.lossy) for k, v in r.asDict().items()} for r in self._collect(lambda: self.query_frame(sql, params), options.timeout)]

    def _collect(self, frame: Callable[[], DataFrame], timeout: float | None) -> list:
        try:
            if timeout is None:
                return frame().collect()
            sc, tag, late = self.spark.sparkContext, f"evlog-{uuid.uuid4().hex}", threading.Event()
            out: dict[str, Any] = {}

            def run() -> None:
                sc.addJobTag(tag)
                try:
                    out["rows"] = frame().collect()
                except Exception as e:  # handed to the caller's thread
                    out["error"] = e

            worker = threading.Thread(target=run, daemon=True)
            worker.start()
            worker.join(timeout)
            while worker.is_alive():
                late.set()
                sc.cancelJobsWithTag(tag)
                worker.join(0.05)
            if late.is_set():
                raise Timeout(f"the statement ran past {timeout} s")
            if "error" in out:
                raise out["error"]
            return out["rows"]
        except PySparkException as e:
            raise Validation(trace.clip(str(e))) from e
