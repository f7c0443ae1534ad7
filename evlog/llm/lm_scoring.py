"""LM scoring (4): a log-frequency Bloom filter of quantised n-gram counts.

Training counts come from all training documents. Documents are dealt to
groups by hash; a group sends each distinct token, bigram and trigram once,
with its count there, to the bucket of its hash. A bucket adds up: it answers
every group with the exact counts of that group's tokens, and turns its
bigrams (seen ``cutoff`` times or more; all of them in op4, where it is 1) and
its trigrams (seen ``TRIGRAMS`` times or more) into its own segment of the
filter: one entry for each level up to 1 + floor(BASE-log(count / cutoff)).
The filter has ``BITS`` bits an entry at every size. It is broadcast in ranges
of buckets of about ``RANGE_BYTES``; where there are several, each is one more
pass over the documents, which notes the levels that it finds, and the passes
meet by row.

The base score uses the exact counts. The model reads an n-gram's level by
probing levels from 1 until one is missing, takes the least count of that level
(of a context, the greatest, so that its probabilities add up to one at most),
and smooths by absolute discounting of interpolated orders:
p(w | t, u) = L3 * max(c(t, u, w) - D, 0) / c(t, u) + L2 * max(c(u, w) - D, 0) / c(u)
+ (1 - L2 - L3) * p1(w), p1 being the add-one unigram probability. The discount
tells what was seen once from what was seen again. The end of a text is also
the context of its first token, which has no trigram.

Defined cases: null or empty text is the end token alone; with no training
document every count, N and V are 0; repeated rows are scored (and, if they
train, counted) each for itself; a null id trains, as its remainder is not 2.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog.llm import textbytes as tb
from evlog.llm.sparkio import partitions, stored

#: Least count of a bigram in the filter, where a caller names none; op4 names 1, so that none is left out.
CUTOFF = 2
BASE = 1.5
BITS = 12
PROBES = 5
#: Least count of a trigram in the filter: nearly all trigrams stand once, and would make it some three times as large.
TRIGRAMS = 2
#: Bytes of the filter that are broadcast at once.
RANGE_BYTES = 192 << 20
L2, L3, DISCOUNT = 0.2, 0.1, 0.5
GROUP_BYTES = 8 << 20
BUCKET_TOKENS = 1_000_000
END = np.uint64(0x5EED0FE4D)
#: The segment of a bucket without n-grams.
NO_SEGMENT = b"\0" * 9


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, each document with its end; n + 1 offsets)."""
    starts, ends, first = tb.word_spans(raw, offs, tb.NONSPACE)
    return np.insert(tb.span_hashes(raw, starts, ends), first[1:], END), first + np.arange(len(first))


def bigrams(seq: np.ndarray) -> np.ndarray:
    return tb.fold(np.append(END, seq[:-1]), seq)


def trigrams(seq: np.ndarray) -> np.ndarray:
    """With an end before each text; at a text's first token there is none (0)."""
    one = np.append(END, seq[:-1])
    two = np.append([END, END], seq[:-2])[: len(seq)]
    return np.where(one == END, np.uint64(0), tb.fold(two, one, seq))


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    new = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[new], np.add.reduceat(counts, new) if len(new) else counts


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes; 255 is followed, at the end, by the true values of all that are 255 or more."""
    low = np.minimum(counts, 255).astype(np.uint8)
    return np.concatenate([low, counts[counts >= 255].astype("<i8").view(np.uint8)])


def _large(data: np.ndarray, n: int) -> np.ndarray:
    out = data[:n].astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:].tobytes(), "<i8")
    return out


class Tally:
    """Counts of one group, folded together whenever much has come in."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append(_summed(hashes, counts))
        self.size += len(self.parts[-1][0])
        if len(self.parts) > 1 and self.size > 4_000_000:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return _summed(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


def segment(hashes: np.ndarray, counts: np.ndarray, most_bytes: int | None = None, cutoff: int = CUTOFF) -> bytes:
    """A bucket's part of the filter, and its highest level in one more byte; scoring sets no ``most_bytes``."""
    keep = counts >= cutoff
    hashes, level = hashes[keep], levels(counts[keep], cutoff)
    size = max(64, int(level.sum()) * BITS)
    if most_bytes is not None:
        size = min(size, most_bytes * 8)
    size = -(-size // 8) * 8
    bits = np.zeros(size, dtype=bool)
    top = int(level.max(initial=0))
    for j in range(1, top + 1):
        for at in positions(hashes[level >= j], j, np.uint64(size)):
            bits[at.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes() + bytes([top])


def ranges(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """(first, end) of the runs of buckets whose segments have at most ``most`` bytes together; a larger segment is a run of its own."""
    cuts, held = [0], 0
    for b, n in enumerate(sizes):
        if held and held + n > most:
            cuts.append(b)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], len(sizes)], strict=True))


def levels(counts: np.ndarray, cutoff: int = CUTOFF) -> np.ndarray:
    return 1 + np.floor(np.log(counts / cutoff) / math.log(BASE) + 1e-9).astype(np.int64)


def least_count(level: np.ndarray, cutoff: int = CUTOFF) -> np.ndarray:
    return np.where(level > 0, np.ceil(cutoff * BASE ** (np.maximum(level, 1) - 1) - 1e-6), 0.0)


def most_count(level: np.ndarray, cutoff: int = CUTOFF) -> np.ndarray:
    """The greatest count of a level."""
    return np.where(level > 0, np.ceil(cutoff * BASE ** np.maximum(level, 1) - 1e-6) - 1, 0.0)


def positions(hashes: np.ndarray, level: int, size: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    a = tb.mix64(hashes + np.uint64(level * 0xA24BAED4963EE407 % 2**64))
    b = tb.mix64(a) | np.uint64(1)
    for _ in range(PROBES):
        yield (a >> np.uint64(8)) % size
        a = a + b


def remainder(hashes: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The 32 bits after those that name the bucket."""
    return hashes << (np.uint64(64) - shift) >> np.uint64(32)


class Filter:
    """The segments of a range of buckets, for probing."""

    def __init__(self, parts: list[bytes]):
        self.size = np.array([8 * (len(p) - 1) for p in parts], dtype=np.uint64)
        self.top = np.array([p[-1] for p in parts], dtype=np.int64)
        self.start = np.cumsum(np.append(0, [len(p) for p in parts]))[:-1]
        self.bits = np.frombuffer(b"".join(parts), np.uint8)

    def level(self, bucket: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The highest level up to which all entries are there; 0 if there is none."""
        out = np.zeros(len(hashes), dtype=np.int64)
        live = np.arange(len(hashes))
        for level in range(1, int(self.top.max(initial=0)) + 1):
            live = live[self.top[bucket[live]] >= level]
            a = tb.mix64(hashes[live] + np.uint64(level * 0xA24BAED4963EE407 % 2**64))
            b = tb.mix64(a) | np.uint64(1)
            for _ in range(PROBES):
                at = (a >> np.uint64(8)) % self.size[bucket[live]]
                hit = (self.bits[self.start[bucket[live]] + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                live, a, b = live[hit], (a + b)[hit], b[hit]
            out[live] = level
        return out


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", cutoff: int = CUTOFF) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    size = int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    groups = max(partitions(spark), -(-size // GROUP_BYTES))
    buckets = 1 << max(4, math.ceil(math.log2(max(1, size / 6 / BUCKET_TOKENS))))
    shift = np.uint64(64 - int(math.log2(buckets)))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")).withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int"))
    dealt = own.repartitionById(groups, "g")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tallies = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind_, tally in tallies.items():
                h, c = tally.total()
                cuts = np.searchsorted(h >> shift, np.arange(buckets + 1, dtype=np.uint64)) if len(h) else np.zeros(buckets + 1, np.int64)
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    x, y = h[cuts[b] : cuts[b + 1]], c[cuts[b] : cuts[b + 1]]
                    # of an n-gram, 32 bits within the bucket are enough: the filter errs more often
                    data = x.tobytes() if kind_ == 1 else remainder(x, shift).astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (b, kind_, now)] + [pa.array([data], pa.binary()), pa.array([_small(y).tobytes()], pa.binary())], ["bucket", "kind", "g", "hashes", "counts"])

        for batch in batches:
            gs = batch.column("g").to_numpy()
            train = ~np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), dtype=bool)
            for i, j, raw, offs in tb.slices(batch.column("text")):
                for a, b in _same(gs[i:j]):
                    g = int(gs[i + a])
                    if g != now:
                        if now is not None:
                            yield from flush()
                        now, tallies = g, {1: Tally(), 2: Tally(), 3: Tally()}
                    seq, first = tokens(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                    learn = np.repeat(train[i + a : i + b], np.diff(first))
                    tallies[1].add(seq, learn.astype(np.int64))
                    tallies[2].add(bigrams(seq)[learn], np.ones(int(learn.sum()), np.int64))
                    three = trigrams(seq)[learn]
                    tallies[3].add(three[three > 0], np.ones(int((three > 0).sum()), np.int64))
        if now is not None:
            yield from flush()

    sent = dealt.select("g", "held_out", "text").mapInArrow(tb.tidy(count), "bucket bigint, kind bigint, g bigint, hashes binary, counts binary")

    def add_up(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, which = key[0].as_py(), key[1].as_py()
        wide = which == 1
        data = [np.frombuffer(x.as_py(), "<u8" if wide else "<u4") for x in rows.column("hashes")]
        counts = [_large(np.frombuffer(x.as_py(), np.uint8), len(h)) for x, h in zip(rows.column("counts"), data, strict=True)]
        out: dict[str, list] = {"bucket": [], "kind": [], "g": [], "hashes": [], "counts": [], "n": [], "v": []}

        def put(*row) -> None:
            for k, v in zip(out, row, strict=True):
                out[k].append(v)

        h, c = _summed(np.concatenate(data), np.concatenate(counts))
        if wide:
            for g, x in zip(rows.column("g").to_pylist(), data, strict=True):
                total = c[np.searchsorted(h, x)]
                put(bucket, 1, g, x[total > 0].tobytes(), _small(total[total > 0]).tobytes(), 0, 0)
            put(bucket, 0, -1, b"", b"", int(c.sum()), int((c > 0).sum()))
        else:
            put(bucket, which, -1, segment(tb.mix64(h.astype(np.uint64)), c, cutoff=cutoff if which == 2 else TRIGRAMS), b"", 0, 0)
        types = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 2
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    answers = stored(sent.groupBy("bucket", "kind").applyInArrow(add_up, "bucket bigint, kind bigint, g bigint, hashes binary, counts binary, n bigint, v bigint"))
    total = answers.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = int(total[0]), int(total[1])
    segments = answers.where("kind > 1")
    sizes = [2 * len(NO_SEGMENT)] * buckets
    for r in segments.groupBy("bucket").agg(F.sum(F.octet_length("hashes")).alias("n")).collect():
        sizes[r.bucket] = r.n
    spans = ranges(sizes, RANGE_BYTES)
    if len(spans) > 1:
        own = stored(own.withColumn("row", F.monotonically_increasing_id()))
    else:
        own = own.withColumn("row", F.lit(0).cast("bigint"))
    both = dealt_union(own, answers.where("kind = 1"), kind).repartitionById(groups, "g").sortWithinPartitions("doc")
    facts = f"row bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double"

    def judged(lo: int, hi: int, whole: bool) -> tuple[DataFrame, Broadcast]:
        """Rows with their score, or with their counts and the levels of the n-grams of buckets lo to hi - 1."""
        parts = {2: [NO_SEGMENT] * (hi - lo), 3: [NO_SEGMENT] * (hi - lo)}
        for r in segments.where(F.col("bucket").between(lo, hi - 1)).select("bucket", "kind", "hashes").toLocalIterator():
            parts[r.kind][r.bucket - lo] = bytes(r.hashes)
        shared = sc.broadcast({k: Filter(v) for k, v in parts.items()})
        return both.mapInArrow(tb.tidy(judge(shared, lo, hi, n, v, shift, cutoff, whole)), f"{facts}, score double" if whole else f"{facts}, counts binary, levels binary"), shared

    if len(spans) == 1:
        scored = judged(*spans[0], True)[0]
    else:
        passes = []
        for lo, hi in spans:
            found, shared = judged(lo, hi, False)
            passes.append(stored(found if not passes else found.select("row", "levels")))
            shared.destroy()
        levels = reduce(DataFrame.unionByName, [p.select("row", "levels") for p in passes]).groupBy("row").agg(F.collect_list("levels").alias("all"))  # one of each range
        met = passes[0].drop("levels").join(levels, "row")

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for counts, all_ in zip(batch.column("counts"), batch.column("all").to_pylist(), strict=True):
                    c = np.frombuffer(counts.as_py(), "<i8")
                    level = np.maximum.reduce([np.frombuffer(x, np.uint8) for x in all_]).astype(np.int64)
                    out.append(float(terms(c, np.array([0, len(c) - 1]), level[: len(c) - 1], level[len(c) - 1 :], n, v, cutoff).sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(out, pa.float64())], [*batch.schema.names[:7], "score"])

        scored = met.mapInArrow(finish, f"{facts}, score double")
    return scored.drop("row").withColumnRenamed("id", id_col)


def terms(c: np.ndarray, first: np.ndarray, two: np.ndarray, three: np.ndarray, n: int, v: int, cutoff: int) -> np.ndarray:
    """log10 p of each token, from the tokens' counts (the end's comes after all of them) and the levels of the n-grams that they end."""
    ends, c = int(c[-1]), c[:-1]
    before = np.append(ends, c[:-1])
    context = np.append(0, most_count(two, cutoff)[:-1])
    before[first[:-1]], context[first[:-1]] = ends, 0
    p = (1 - L2 - L3) * (c + 1.0) / (n + v + 1)
    p += L2 * np.maximum(least_count(two, cutoff) - DISCOUNT, 0) / np.maximum(before, 1)
    p += np.where(context > 0, L3 * np.maximum(least_count(three, TRIGRAMS) - DISCOUNT, 0) / np.maximum(context, 1), 0)
    return np.log10(np.minimum(p, 1.0))


def judge(shared: Broadcast, lo: int, hi: int, n: int, v: int, shift: np.uint64, cutoff: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores documents, which follow the answers to their group; ``whole``: buckets lo to hi - 1 are all there are."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        now, known_h, known_c, pending = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        low = math.log10(1 / (n + v + 1))
        for batch in batches:
            gs, doc = batch.column("g").to_numpy(), np.asarray(batch.column("doc").to_numpy(zero_copy_only=False), dtype=bool)
            for a, b in _same(gs * 2 + doc):
                g = int(gs[a])
                if g != now:
                    now, known_h, known_c, pending = g, np.zeros(0, np.uint64), np.zeros(0, np.int64), []
                part = batch.slice(a, b - a)
                if not doc[a]:
                    for x, y in zip(part.column("hashes"), part.column("counts"), strict=True):
                        h = np.frombuffer(x.as_py(), "<u8")
                        pending.append((h, _large(np.frombuffer(y.as_py(), np.uint8), len(h))))
                    continue
                if pending:
                    known_h, known_c = np.concatenate([p[0] for p in pending]), np.concatenate([p[1] for p in pending])
                    order = np.argsort(known_h)
                    known_h, known_c, pending = known_h[order], known_c[order], []
                for i, j, raw, offs in tb.slices(part.column("text")):
                    seq, first = tokens(raw, offs)
                    c = np.zeros(len(seq), np.int64)
                    if len(known_h):
                        at = np.minimum(np.searchsorted(known_h, seq), len(known_h) - 1)
                        c = np.where(known_h[at] == seq, known_c[at], 0)
                    ends = int(c[first[1] - 1])
                    level = {}
                    for k, grams in ((2, bigrams(seq)), (3, trigrams(seq))):
                        level[k] = np.zeros(len(seq), np.int64)
                        bucket = (grams >> shift).astype(np.int64)
                        here = np.flatnonzero((bucket >= lo) & (bucket < hi) & (grams > 0))
                        level[k][here] = filters[k].level(bucket[here] - lo, tb.mix64(remainder(grams[here], shift)))
                    columns = [part.column(x).slice(i, j - i) for x in ("row", "id", "held_out")]
                    columns += [pa.array(np.diff(first)), pa.array(np.add.reduceat((c > 0).astype(np.int64), first[:-1])), pa.array(np.full(j - i, n)), pa.array(np.add.reduceat(np.log10(c + 1.0) + low, first[:-1]))]
                    names = ["row", "id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
                    if whole:
                        own = terms(np.append(c, ends), first, level[2], level[3], n, v, cutoff)
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.add.reduceat(own, first[:-1]))], [*names, "score"])
                    else:
                        spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                        counts = [np.append(c[x:y], ends).astype("<i8").tobytes() for x, y in spans]
                        found = [np.concatenate([level[2][x:y], level[3][x:y]]).astype(np.uint8).tobytes() for x, y in spans]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.binary()), pa.array(found, pa.binary())], [*names, "counts", "levels"])

    return score


def dealt_union(docs: DataFrame, answers: DataFrame, kind: str) -> DataFrame:
    """Documents and the answers to their groups in one frame; within a group the answers sort first."""
    none = F.lit(None)
    return answers.select(F.col("g").cast("int").alias("g"), F.lit(False).alias("doc"), none.cast(kind).alias("id"), none.cast("boolean").alias("held_out"), none.cast("bigint").alias("row"), none.cast("string").alias("text"), "hashes", "counts").unionByName(docs.select("g", F.lit(True).alias("doc"), "id", "held_out", "row", "text", none.cast("binary").alias("hashes"), none.cast("binary").alias("counts")))


def _same(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    cuts = [*np.flatnonzero(np.diff(values, prepend=values[0] - 1)).tolist(), len(values)] if len(values) else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))
