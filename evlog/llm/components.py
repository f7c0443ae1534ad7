"""Connected components of an edge list: in one task up to a bound, beyond it by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog.llm import textbytes as tb
from evlog.llm.sparkio import dropped, stored

#: Edges (16 bytes each) that one task takes at once. Rounds of star contraction are some nine jobs each, and the driver keeps plans and figures of them all.
AT_ONCE = 1_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the edges, sorted, and the smallest id that each reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(x):
        x, y = root[x], root[y]
        x, y = np.maximum(x, y), np.minimum(x, y)
        x, y = x[x != y], y[x != y]
        np.minimum.at(root, x, y)
        while not np.array_equal(up := root[root], root):
            root = up
    return ids, ids[root]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for batch in batches:
        u.append(batch.column("u").to_numpy())
        v.append(batch.column("v").to_numpy())
    if u:
        ids, least = least_reachable(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["id", "comp"])


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(id, comp), stored, for every id in ``edges`` (columns a, b, bigint) that has an edge to another: comp is the smallest id reachable.

    Up to ``at_once`` edges go to one task; more are contracted in rounds. There,
    hubs are handled by map-side minima and joins, never by gathering neighbours;
    each round is written to the shared folder, so a lost executor costs one round;
    rounds go on until nothing moves, and their number grows with the logarithm of a path's length.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    if now.count() <= at_once:
        out = stored(now.repartition(1).mapInArrow(tb.tidy(_in_one_task), "id bigint, comp bigint"))
        dropped(now)
        return out
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, now = now, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        dropped(old)
        if (new := _state(now)) == state:
            break
        state = new
    out = stored(now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()))
    dropped(now)
    return out
