"""The log as a Spark data source: ``spark.readStream.format("evlog").option("path", root)``.

Offsets are positions. A micro-batch is the segments between two positions,
one input partition each, read by Arrow on the executors; filters on position,
kind and stream are applied there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from evlog.functions.prefix import stream_prefix_bound
from evlog.schema import COLUMNS, LOG_SCHEMA
from evlog.store.manifest import Manifest


@dataclass
class SegmentPart(InputPartition):
    path: str
    above: int
    through: int


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.kinds = json.loads(options.get("kinds", "null"))
        self.streams = json.loads(options.get("streams", "null"))
        self.prefix = options.get("stream_prefix") or ""
        self.start = int(options.get("from", "0"))

    def head(self) -> int:
        return Manifest(self.root).refresh().head

    def parts(self, above: int, through: int) -> list[SegmentPart]:
        m = Manifest(self.root)
        return [SegmentPart(m.check(s), above, through) for s in sorted(m.refresh().segments.values(), key=lambda s: s.min_position) if s.max_position > above and s.min_position <= through]

    def read(self, part: SegmentPart) -> Iterator[pa.RecordBatch]:
        want = (ds.field("position") > part.above) & (ds.field("position") <= part.through)
        if self.kinds is not None:
            want &= ds.field("kind").isin(self.kinds)
        if self.streams is not None:
            want &= ds.field("stream").isin(self.streams)
        if self.prefix:
            want &= ds.field("stream") >= self.prefix
            if (bound := stream_prefix_bound(self.prefix)) is not None:
                want &= ds.field("stream") < bound
        yield from ds.dataset(part.path, format="parquet").scanner(columns=COLUMNS, filter=want).to_batches()


class BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[SegmentPart]:
        return self.parts(self.start, self.head())


class StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"position": self.start}

    def latestOffset(self) -> dict:
        return {"position": max(self.start, self.head())}

    def partitions(self, start: dict, end: dict) -> list[SegmentPart]:
        return self.parts(start["position"], end["position"])

    def commit(self, end: dict) -> None:
        """Nothing to do: the cursor that counts is the consumer's checkpoint."""


class EvlogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evlog"

    def schema(self):
        return LOG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options)


def stream_frame(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """A streaming DataFrame of the log's rows, in stored shape."""
    spark.dataSource.register(EvlogSource)
    return spark.readStream.format("evlog").option("path", root).options(**options).load()
