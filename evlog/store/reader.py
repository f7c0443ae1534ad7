"""Stored rows in order of position, read from the segments as they are asked for."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq

from evlog.schema import COLUMNS
from evlog.store.manifest import Segment

#: Rows that are decoded at once, and those that become Python objects at once.
DECODE, SLICE = 4096, 256


class _Enough(Exception):
    pass


class Reader:
    """Rows after a position that meet a condition on stored columns and a test on rows.

    A segment is opened when its range is reached, row groups below the position are passed over, and a slice of each open segment is held.
    With ``most``, it ends when so many rows after the position were looked at; ``whole`` says whether these were all.
    """

    def __init__(self, segments: Sequence[Segment], check: Callable[[Segment], str], from_: int, want: pc.Expression | None, test: Callable[[dict[str, Any]], bool] | None = None, most: int | None = None):
        self.segments, self.check, self.from_, self.want, self.test, self.left = segments, check, from_, want, test, most
        self.whole = True

    def __iter__(self) -> Iterator[dict[str, Any]]:
        waiting = deque(sorted(self.segments, key=lambda s: s.min_position))
        heads: list[tuple[int, int, dict[str, Any], Iterator[dict[str, Any]]]] = []
        try:
            while waiting or heads:
                if waiting and (not heads or waiting[0].min_position < heads[0][0]):
                    rest = self._rows(waiting.popleft())
                    if (row := next(rest, None)) is not None:
                        heapq.heappush(heads, (row["position"], len(waiting), row, rest))
                    continue
                _, i, row, rest = heads[0]
                yield row
                if (row := next(rest, None)) is None:
                    heapq.heappop(heads)
                else:
                    heapq.heapreplace(heads, (row["position"], i, row, rest))
        except _Enough:
            self.whole = False

    def _rows(self, s: Segment) -> Iterator[dict[str, Any]]:
        with pq.ParquetFile(self.check(s), pre_buffer=False) as file:
            meta = file.metadata
            at = file.schema_arrow.get_field_index("position")
            groups = [g for g in range(meta.num_row_groups) if meta.row_group(g).column(at).statistics.max > self.from_]
            for batch in file.iter_batches(DECODE, row_groups=groups, columns=COLUMNS):
                positions = batch.column("position").to_numpy()
                if positions[0] <= self.from_:
                    batch = batch.slice(int(np.searchsorted(positions, self.from_, side="right")))
                if self.left is not None:
                    if self.left <= 0 and batch.num_rows:
                        raise _Enough
                    self.left -= batch.num_rows
                if self.want is not None:
                    batch = batch.filter(self.want)
                for start in range(0, batch.num_rows, SLICE):
                    part = batch.slice(start, SLICE)
                    for values in zip(*[part.column(c).to_pylist() for c in COLUMNS], strict=True):
                        row = dict(zip(COLUMNS, values, strict=True))
                        if self.test is None or self.test(row):
                            yield row
