"""Approximate nearest neighbours (6): multi-index hashing over learned rotated binary codes.

Vectors get one more dimension that makes all norms equal, so that the largest
inner product is the smallest angle. Rotations are learned on a bounded sample
(``SAMPLE`` vectors, of the smallest id hashes) by iterative quantisation; the
signs of the rotated vector are its code of ``BITS`` bits, cut into substrings
of 16. All rows are dealt to shards of about ``SHARD``; a shard keeps, for each
substring, the members of each of its values. A query looks up, in each
substring, all values within a few bits of its own: with radius = m * s + a,
a + 1 of the m substrings are probed to s bits and the others to s - 1, which
by the pigeonhole principle retrieves every code within the radius. What is
retrieved and within ``reach`` bits as a whole is ranked by the exact inner
product in double precision.

Radius and reach are learned: ``PROBES`` vectors of the sample are compared
with all rows, and the radius is the least that retrieves the share ``RECALL``
of their true neighbours (more than lie within the radius: a neighbour is
found when any one substring is near enough).

Queries are a stated set. Each is sent to every shard, where it follows the
shard's rows in one sorted partition, so that neither the driver nor a
broadcast holds queries; a shard sends ``K`` rows a query on.

Defined cases: vectors that are null, zero, of another length than most, or
that hold null or non-finite components take no part, as queries or candidates;
rows with the query's own id are not its candidates; of several query rows with
one id the first in order of components asks; repeated vectors tie, and ties go
to the smaller id; products beyond the range of doubles are infinite, and those
that are no number come last; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evlog.llm.sparkio import stored

K = 20
BITS = 1024
SUB = 16
RECALL = 0.96
#: Share of true neighbours within reach.
REACH = 0.998
SAMPLE = 4096
PROBES = 64
SHARD = 32_768
ROUNDS = 12
_ALL = np.arange(1 << SUB, dtype=np.uint16)
#: All substrings, those with fewer bits set first, and how many have at most so many.
_MASKS = _ALL[np.argsort(np.bitwise_count(_ALL), kind="stable")]
_WITHIN = np.cumsum(np.bincount(np.bitwise_count(_ALL)))


class Codes:
    """Learned rotations; ``code`` gives the substrings (n x BITS / 16, 16 bits each). ``scale``: the greatest component there is."""

    def __init__(self, sample: np.ndarray, scale: float, bits: int = BITS):
        self.scale = scale
        x = sample / scale
        self.largest = np.sqrt((x * x).sum(axis=1)).max()
        x = self._lift(x)
        dim = x.shape[1]
        self.mean = x.mean(axis=0)
        x = x - self.mean
        rng = np.random.default_rng(7)
        turns = []
        while sum(t.shape[1] for t in turns) < bits:
            r, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
            for _ in range(ROUNDS):  # the rotation that is nearest to the signs, and the signs again
                u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x, full_matrices=False)
                r = (u @ v).T
            turns.append(r)
        self.turn = np.concatenate(turns, axis=1)[:, :bits]

    def _lift(self, x: np.ndarray) -> np.ndarray:
        """Scaled to the sample's longest vector; longer ones (they are outside the sample) count as that long."""
        scaled = x / self.largest
        return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))])

    def code(self, x: np.ndarray, data: bool) -> np.ndarray:
        x = x / self.scale
        if not data:  # a query's length doesn't change its order; its own scale does for the code
            x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300) * self.largest
        bits = (self._lift(x) - self.mean) @ self.turn >= 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


class Shard:
    """A multi-index of one shard: the members of each value of each substring."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes):
        self.ids, self.vectors = ids, vectors
        subs = codes.code(vectors, True)
        self.whole = np.ascontiguousarray(subs).view(np.uint64)
        self.m = subs.shape[1]
        self.members = np.empty((self.m, len(ids)), np.int32)
        self.start = np.zeros((self.m, (1 << SUB) + 1), np.int32)
        for j in range(self.m):
            self.members[j] = np.argsort(subs[:, j], kind="stable")
            np.cumsum(np.bincount(subs[:, j], minlength=1 << SUB), out=self.start[j, 1:])
        self.members, self.start = self.members.ravel(), self.start.ravel()

    def probe(self, subs: np.ndarray, radius: int) -> np.ndarray:
        """Members of the buckets within the radius: every code within it, and more."""
        s, a = divmod(radius, self.m)
        near = np.zeros(len(self.ids), dtype=bool)
        for lo, hi, reach in ((0, a + 1, s), (a + 1, self.m, s - 1)):
            if reach < 0 or lo >= hi:
                continue
            value = (subs[lo:hi, None] ^ _MASKS[None, : _WITHIN[min(reach, SUB)]]).astype(np.int64)
            at = value + np.arange(lo, hi)[:, None] * ((1 << SUB) + 1)
            first, count = self.start[at], self.start[at + 1] - self.start[at]
            first = (first + np.arange(lo, hi, dtype=np.int64)[:, None] * len(self.ids)).ravel()
            count = count.ravel()
            full = np.flatnonzero(count)
            first, count = first[full], count[full]
            ends = np.cumsum(count)
            if len(ends):
                near[self.members[np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]))]] = True
        return np.flatnonzero(near)

    def within(self, subs: np.ndarray, radius: int, reach: int | None = None) -> tuple[np.ndarray, int]:
        """(what is retrieved and within reach (the radius, if none is given), how many codes were compared)."""
        found = self.probe(subs, radius)
        distance = np.bitwise_count(self.whole[found] ^ subs.view(np.uint64)).sum(axis=1, dtype=np.int64)
        return found[distance <= (radius if reach is None else reach)], len(found)

    def nearest(self, query_id: int, query: np.ndarray, subs: np.ndarray, k: int, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray, float]:
        found, compared = self.within(subs, radius, reach)
        want = min(k, int((self.ids != query_id).sum()))
        while (self.ids[found] != query_id).sum() < want:  # a shard gives k, or all it has
            radius, reach = radius + self.m // 2, reach + 2 * self.m
            found, compared = self.within(subs, radius, reach)
        found = found[self.ids[found] != query_id]
        with np.errstate(over="ignore", invalid="ignore"):
            score = (self.vectors[found] * query).sum(axis=1)
        best = np.lexsort((self.ids[found], -np.where(np.isnan(score), -np.inf, score), np.isnan(score)))[:k]
        return self.ids[found][best], score[best], compared / len(self.ids)


def valid(df: DataFrame, is_query: Column, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, q): the vectors that take part, as doubles, and whether they ask."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(ok)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].d if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def true_neighbours(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, codes: Codes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, code) of the k nearest rows of each query, by comparing all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_id, held_v, held_s = [np.zeros(0, np.int64)] * len(ids), [np.zeros((0, queries.shape[1]))] * len(ids), [np.zeros(0)] * len(ids)
        for batch in batches:
            own, v = batch.column("id").to_numpy(), _matrix(batch.column("v"))
            scores = (v / codes.scale) @ (queries / codes.scale).T
            for i in range(len(ids)):
                at = np.flatnonzero(own != ids[i])
                s = np.append(held_s[i], scores[at, i])
                best = np.argsort(-s, kind="stable")[:k]
                held_id[i], held_v[i], held_s[i] = np.append(held_id[i], own[at])[best], np.concatenate([held_v[i], v[at]])[best], s[best]
        for i in range(len(ids)):
            if len(held_s[i]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held_s[i]), i)), pa.array(held_s[i]), pa.array(codes.code(held_v[i], True).astype(np.int32).tolist(), pa.list_(pa.int32()))], ["i", "score", "code"])

    found = rows.select("id", "v").mapInArrow(run, "i bigint, score double, code array<int>")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score")))).where(F.col("r") <= k).collect()  # k rows a query
    return np.array([r.i for r in best]), np.array([r.code for r in best], dtype=np.uint16)


def learned_radius(query: np.ndarray, near: np.ndarray, recall: float) -> tuple[int, int]:
    """(radius, reach) that retrieve the share ``recall`` of the pairs of codes."""
    apart = np.bitwise_count(query ^ near).astype(np.int64)
    m = apart.shape[1]
    # the least radius that retrieves a pair: substring j is probed to b bits from m * b + max(0, j) on
    least = (apart * m + np.arange(m)).min(axis=1)
    at = lambda values, share: int(np.sort(values)[min(len(values) - 1, int(np.ceil(share * len(values))) - 1)])
    return at(least, recall), at(apart.sum(axis=1), REACH) + 2


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, and probed (the share of the shard whose codes were compared)."""
    spark = df.sparkSession
    rows = stored(valid(df, is_query, id_col, vec_col))
    total, scale = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, probed double")
    bound = int(-(2**63) + min(1.0, (SAMPLE - 4 * SAMPLE**0.5) / total) * (2**64 - 1)) if total > SAMPLE else 2**63 - 1
    sample = rows.where(F.xxhash64("id") <= bound).orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("id", "v").collect()
    codes = Codes(np.array([r.v for r in sample]), scale)
    some = sample[:PROBES]
    asked = np.array([r.v for r in some])
    who, near = true_neighbours(rows, np.array([r.id for r in some]), asked, codes, k)
    radius, reach = learned_radius(codes.code(asked, False)[who], near, recall) if len(who) else (0, 0)
    shards = -(-total // SHARD)
    data = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "v")
    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "v")
    dealt = data.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            key = batch.column("shard").to_numpy() * 2 + np.asarray(batch.column("asks").to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                shard, asks = divmod(int(key[a]), 2)
                if shard != now:
                    now, held, index = shard, [], None
                part = batch.slice(a, b - a).select(["id", "v"])
                if not asks:
                    held.append(part)
                    continue
                if index is None:
                    if not held:
                        continue  # a shard without rows
                    whole = pa.Table.from_batches(held).combine_chunks()
                    index, held = Shard(whole.column("id").to_numpy(), _matrix(whole.column("v").combine_chunks()), codes), []
                own, vectors = part.column("id").to_numpy(), _matrix(part.column("v"))
                subs = codes.code(vectors, False)
                q, v, s, p = [], [], [], []
                for i in range(len(own)):
                    found, score, share = index.nearest(int(own[i]), vectors[i], subs[i], k, radius, reach)
                    q.append(np.full(len(found), own[i]))
                    v.append(found)
                    s.append(score)
                    p.append(np.full(len(found), share))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q, v, s, p)], ["query_id", "vec_id", "score", "probed"])

    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double, probed double")
    number = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    best = Window.partitionBy("query_id").orderBy(F.isnan("score"), number.desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "probed")
