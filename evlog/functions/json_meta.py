"""Typed equality on keys of a JSON column, through VARIANT."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from evlog.errors import Validation

Scalar = str | int | float | bool


def check_key(key: str) -> str:
    if not isinstance(key, str) or not key or '"' in key:
        raise Validation(f"meta key {key!r} can't be filtered on")
    return key


def check_value(value: object) -> Scalar:
    if not isinstance(value, str | int | float | bool):
        raise Validation("a meta filter takes a string, a number or a boolean")
    return value


def json_value(column: Column, key: str) -> Column:
    return F.try_variant_get(F.parse_json(column), f'$["{check_key(key)}"]', "variant")


def meta_equals(column: Column, key: str, value: Scalar) -> Column:
    """Strings equal strings only, numbers equal numbers of any width; booleans count as 1 and 0. A missing key equals nothing."""
    check_value(value)
    v = json_value(column, key)
    kind = F.schema_of_variant(v)
    get = lambda t: F.try_variant_get(v, "$", t)
    if isinstance(value, str):
        return F.coalesce((kind == "STRING") & (get("string") == value), F.lit(False))
    number = int(value) if isinstance(value, bool) else value
    whole = number if float(number).is_integer() and abs(number) < 2**63 else None
    same = (kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (get("double") == float(number))
    if whole is not None:
        same = same | ((kind == "BIGINT") & (get("bigint") == int(whole)))
        if whole in (0, 1):
            same = same | ((kind == "BOOLEAN") & (get("boolean") == F.lit(whole == 1)))
    return F.coalesce(same, F.lit(False))


def meta_equals_value(meta: dict, key: str, value: Scalar) -> bool:
    """The same rule for a parsed object."""
    if key not in meta:
        return False
    have = meta[key]
    if isinstance(value, str) or isinstance(have, str):
        return isinstance(value, str) and isinstance(have, str) and value == have
    return have == value  # True == 1 and 40 == 40.0, as above


def index_columns(key: str) -> tuple[str, str]:
    """Names of the columns that an indexed key has in a segment: its strings, and its numbers and booleans as doubles."""
    name = check_key(key).encode().hex()
    return f"_s_{name}", f"_n_{name}"


def index_values(column: Column, key: str) -> dict[str, Column]:
    """The same columns as expressions over stored rows."""
    v = json_value(column, key)
    kind = F.schema_of_variant(v)
    text, number = index_columns(key)
    get = lambda t: F.try_variant_get(v, "$", t)
    return {text: F.when(kind == "STRING", get("string")), number: F.when(kind == "BOOLEAN", get("boolean").cast("double")).when(kind != "STRING", get("double"))}


def indexed_table(table: pa.Table, key: str) -> pa.Table:
    """The same for a table on the driver."""
    import json

    values = [json.loads(m).get(key) for m in table.column("meta").to_pylist()]
    text, number = index_columns(key)
    strings = [v if isinstance(v, str) else None for v in values]
    numbers = [float(v) if isinstance(v, int | float) and abs(v) < 1.7e308 else None for v in values]
    return table.append_column(text, pa.array(strings, pa.string())).append_column(number, pa.array(numbers, pa.float64()))


def index_key(key: str, value: Scalar) -> tuple[str, str | float]:
    """(column, value) that rows equal to the value have; the typed test still follows."""
    text, number = index_columns(key)
    return (text, value) if isinstance(value, str) else (number, float(value))


def register(spark: SparkSession) -> None:
    """SQL: json_extract(column, path) as text, scalars bare; a SQL function, so that it stays in the plan."""
    spark.sql("create or replace temporary function json_extract(doc string, path string) returns string return get_json_object(doc, path)")
