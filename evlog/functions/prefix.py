"""Stream-name prefixes as ranges, so that they reach the Parquet scan as two comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stream_prefix_bound(prefix: str) -> str | None:
    """The least string above all strings with the prefix, by code point; None if there is none."""
    points = [ord(c) for c in prefix]
    while points:
        last = points.pop()
        if last < 0x10FFFF:
            last = 0xE000 if last == 0xD7FF else last + 1  # surrogates are no characters
            return "".join(map(chr, points)) + chr(last)
    return None


def has_prefix(column: Column, prefix: str) -> Column:
    if not prefix:
        return F.lit(True)
    bound = stream_prefix_bound(prefix)
    low = column >= prefix
    return low if bound is None else low & (column < bound)
