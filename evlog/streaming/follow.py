"""A projection driven by Structured Streaming: exactly once, by the log's own cursor.

Spark's checkpoint and our commit can't be one; a batch that is replayed after
a crash between them finds its rows at or before the cursor and is passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evlog.project import ProjectionRunner
from evlog.streaming.source import stream_frame


def follow(runner: ProjectionRunner, checkpoint: str, available_now: bool = True, every: str = "100 milliseconds") -> StreamingQuery:
    """Start the query; with ``available_now`` it ends when it has seen all there is."""
    log = runner.log

    def batch(rows: DataFrame, _: int) -> None:
        rows.persist()
        try:
            through = rows.agg(F.max("position")).first()[0]
            if through is not None:
                runner.run_frame(rows, through)
        finally:
            rows.unpersist()

    writer = stream_frame(log.spark, log.manifest.root).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
