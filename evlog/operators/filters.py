"""The filter of scans: four axes, all of which must hold."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evlog.errors import Validation
from evlog.functions.json_meta import Scalar, check_key, check_value, meta_equals, meta_equals_value
from evlog.functions.prefix import has_prefix

MAX_MEMBERS = 32_766


@dataclass(frozen=True)
class Filter:
    """None is no condition; an empty set selects nothing; an empty prefix and no meta pairs select all."""

    kinds_: frozenset[str] | None = None
    streams_: frozenset[str] | None = None
    meta_: tuple[tuple[str, Scalar], ...] = ()
    prefix_: str | None = None

    @staticmethod
    def all() -> Filter:
        return Filter()

    @staticmethod
    def of_kinds(kinds: Iterable[str]) -> Filter:
        return Filter(kinds_=frozenset(kinds))

    def kinds(self, kinds: Iterable[str]) -> Filter:
        return replace(self, kinds_=frozenset(kinds))

    def stream(self, stream: str) -> Filter:
        return replace(self, streams_=frozenset([stream]))

    def streams(self, streams: Iterable[str]) -> Filter:
        return replace(self, streams_=frozenset(streams))

    def stream_prefix(self, prefix: str) -> Filter:
        return replace(self, prefix_=prefix)

    def meta(self, key: str, value: Scalar) -> Filter:
        return replace(self, meta_=(*self.meta_, (key, value)))

    @property
    def selects_nothing(self) -> bool:
        return self.kinds_ == frozenset() or self.streams_ == frozenset()

    @property
    def whole(self) -> bool:
        """Whether no axis restricts it."""
        return self.kinds_ is None and self.streams_ is None and not self.meta_ and not self.prefix_

    def validate(self) -> None:
        for key, value in self.meta_:
            check_key(key)
            check_value(value)
        for members in (self.kinds_, self.streams_):
            if members is not None and len(members) > MAX_MEMBERS:
                raise Validation(f"a filter axis takes {MAX_MEMBERS} members at most")

    def column(self) -> Column:
        """The condition on stored columns. Kind, stream and prefix reach the Parquet scan; meta doesn't."""
        if self.selects_nothing:
            return F.lit(False)
        self.validate()
        parts = []
        if self.kinds_ is not None:
            parts.append(F.col("kind").isin(sorted(self.kinds_)))
        if self.streams_ is not None:
            parts.append(F.col("stream").isin(sorted(self.streams_)))
        if self.prefix_:
            parts.append(has_prefix(F.col("stream"), self.prefix_))
        parts += [meta_equals(F.col("meta"), k, v) for k, v in self.meta_]
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def matches(self, stream: str, kind: str, meta: dict) -> bool:
        """The same for one event on the driver."""
        if self.kinds_ is not None and kind not in self.kinds_:
            return False
        if self.streams_ is not None and stream not in self.streams_:
            return False
        return stream.startswith(self.prefix_ or "") and all(meta_equals_value(meta, k, v) for k, v in self.meta_)
