"""Suffix-array dedup (2): every byte covered by a repeated string of ``LENGTH`` bytes is found.

A full suffix array over every byte would shuffle many times the input. Instead
the array is sparse, and exact all the same:

1. Suffixes start at anchors: in every window of ``LENGTH`` bytes the position
   whose next ``LEAD`` bytes hash lowest (the leftmost of equals). Two equal
   windows have their anchor at the same place, so any repeat shows up between
   two suffixes that share their first ``LEAD`` bytes. Anchors alone with their
   lead are dropped, by a count over the corpus and a join that splits skew.
2. Anchors whose whole context (as far as a window can reach) occurs twice are
   settled by that count: copies never meet in one task. Contexts of one lead
   are told apart by 64 bits of hash.
3. One suffix for each distinct context goes on. Sampled splitters
   range-partition the suffixes by their leading bytes; equal leads never
   straddle a boundary, so no comparison is lost between buckets. A lead of
   more than ``HOT`` contexts is split by the bytes that follow it and, a second
   time, by those before it: two suffixes that share a window share half of
   what it has beyond the lead on one side, so that every comparison that
   such a cut parts is made on the other side. Where even those are more than
   ``HOT``, the windows themselves are counted, by 64 bits of hash.
4. In a bucket, multikey quicksort over 8-byte tokens sorts the suffixes, and
   the reversed text before them; neighbours' common lengths give, for each
   offset of a window, the classes of equal left and right parts. A window
   repeats where another suffix is in the same pair of classes.

Defined cases: null or empty text has no bytes; text shorter than ``LENGTH``
loses nothing; repeated rows are documents of their own (their whole texts
repeat); rows are numbered, so texts under one id or a null id keep their runs
apart; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog.llm import textbytes as tb
from evlog.llm.sparkio import dropped, partitions, stored

LENGTH = 200
LEAD = 40
RESULTS = ("n_bytes", "n_removed", "spans", "kept", "kept_sha256")
#: Suffixes of a bucket, about.
BUCKET = 50_000
#: Contexts that are compared in one task, at most, for one lead.
HOT = 20_000


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each run of w values (len(x) - w + 1 of them)."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH, lead: int = LEAD) -> tuple[np.ndarray, ...]:
    """(document, position, left and right reach, lead hash, context hash) of each anchor."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offs)
    n = np.maximum(sizes - length + 1, 0)
    if not n.any():
        return none, none, none, none, none, none
    p, q = tb.powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(tb.BYTE64[raw] * p[: len(raw)], out=sums[1:])
    grams = len(raw) - lead + 1
    h = tb.mix64((sums[lead:] - sums[:grams]) * q[:grams])
    bits = np.uint64(int(grams).bit_length())
    keyed = (h >> bits << bits) | np.arange(grams, dtype=np.uint64)
    low = _sliding_min(keyed, length - lead + 1)
    at = (low[tb.spread(offs[:-1], n)] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.diff(at, prepend=-1) != 0]
    doc = np.searchsorted(offs, at, side="right") - 1
    left = np.minimum(at - offs[doc], length - lead)
    right = np.minimum(offs[doc + 1] - at, length)
    context = tb.fold((sums[at + right] - sums[at - left]) * q[at - left], (left * 1000 + right).astype(np.uint64), h[at])
    return doc, at - offs[doc], left, right, h[at].view(np.int64), context.view(np.int64)


def multikey_sort(tokens: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The order of rows of 8-byte tokens: each level splits only the runs that the levels before left equal.

    Shorter rows (padded with zeros) come before longer ones that are equal so far.
    """
    order = np.argsort(tokens[:, 0], kind="stable")
    run = np.cumsum(np.append(0, np.diff(tokens[order, 0]) != 0))
    for column in [*tokens.T[1:], length]:
        tied = np.append(np.diff(run) == 0, False)
        tied[1:] |= tied[:-1]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        sub = np.lexsort((column[order[at]], run[at]))
        order[at] = order[at][sub]
        value = column[order]
        run = np.cumsum(np.append(0, (np.diff(run) != 0) | (value[1:] != value[:-1])))
    return order


def _common(rows: np.ndarray, length: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common length of each row with the one before it in order (0 for the first)."""
    out = np.zeros(len(order), dtype=np.int64)
    for a in range(1, len(order), 65_536):
        b = min(a + 65_536, len(order))
        x, y = order[a - 1 : b - 1], order[a:b]
        differ = rows[x] != rows[y]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[a:b] = np.minimum(same, np.minimum(length[x], length[y]))
    return out


def repeated_offsets(context: list[bytes], left: np.ndarray, length: int = LENGTH, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance from each anchor back to the start of a window that another context has too (-1: none).

    Windows of one anchor overlap, so what they cover is one run.
    """
    n, reach = len(context), length - lead
    size = np.array([len(c) for c in context])
    right = size - left
    after = np.zeros((n, -(-length // 8) * 8), dtype=np.uint8)
    before = np.zeros((n, -(-reach // 8) * 8), dtype=np.uint8)
    flat = np.frombuffer(b"".join(context), np.uint8)
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(n), right)
    after[row, tb.spread(np.zeros(n, np.int64), right)] = flat[tb.spread(start + left, right)]
    row = np.repeat(np.arange(n), left)
    back = tb.spread(np.zeros(n, np.int64), left)
    before[row, left[row] - 1 - back] = flat[start[row] + back]
    sides = []
    for rows, own in ((after, right), (before, left)):
        tokens = rows.view(">u8").astype(np.uint64)
        order = multikey_sort(tokens, own)
        common = _common(rows, own, order)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        most = np.maximum(common, np.append(common[1:], 0))[place]
        sides.append((common, place, most))
    (rc, rp, rm), (lc, lp, lm) = sides
    least, greatest = np.full(n, -1), np.full(n, -1)
    for back in range(reach + 1):
        ahead = length - back
        live = np.flatnonzero((rm >= ahead) & (lm >= back) & (left >= back))
        if len(live) < 2:
            continue
        right_class = np.cumsum(rc < ahead)[rp[live]]
        left_class = np.cumsum(lc < back)[lp[live]]
        pair = (right_class.astype(np.uint64) << np.uint64(32)) | left_class.astype(np.uint64)
        _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        hit = live[count[inverse] > 1]
        least[hit] = np.where(least[hit] < 0, back, least[hit])
        greatest[hit] = back
    return least, greatest


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def window_hashes(batches: Iterator[pa.RecordBatch], length: int, lead: int) -> Iterator[pa.RecordBatch]:
    """A hash of each window of each context, with its distance back from the anchor."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            context = part.column("context").to_pylist()
            raw = np.frombuffer(b"".join(context), np.uint8)
            size = np.array([len(c) for c in context])
            start = np.cumsum(size) - size
            left = part.column("at").to_numpy() >> 10 & 1023
            n = np.maximum(size - length + 1, 0)
            row = np.repeat(np.arange(len(context)), n)
            first = tb.spread(start, n)
            back = left[row] - (first - start[row])
            good = (back >= 0) & (back <= length - lead)
            row, first, back = row[good], first[good], back[good]
            w = tb.span_hashes(raw, first, first + length, tb.BYTE64).view(np.int64)
            take = lambda c: part.column(c).take(pa.array(row))
            side = pa.array(np.array([x[0] for x in part.column("lead").to_pylist()], dtype=np.int32)[row])
            yield pa.RecordBatch.from_arrays([take("id"), take("at"), take("c"), side, pa.array(back.astype(np.int32)), pa.array(w)], ["id", "at", "c", "side", "back", "w"])


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """(id, runs): for each document with repeats, its runs (array of start and end bytes, neither merged nor sorted)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offs in tb.slices(batch.column("text")):
                doc, at, left, right, h, f = anchors(raw, offs, length, lead)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i).take(pa.array(doc)), pa.array(at << 20 | left << 10 | right), pa.array(h), pa.array(f)], ["id", "at", "h", "f"])

    found = texts.mapInArrow(tb.tidy(find), f"id {kind}, at bigint, h bigint, f bigint")
    shared = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))  # kept apart, so that the join can split a hot lead
    open_ = stored(found.join(shared, "h"))
    contexts = open_.groupBy("h", "f").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "at")).alias("x"))
    contexts = stored(contexts.select("h", "f", "c", "x.id", "x.at"))
    left, right = F.shiftright("at", 10).bitwiseAND(1023), F.col("at").bitwiseAND(1023)
    run = lambda a, b: F.struct((F.shiftright("at", 20) - a).alias("a"), (F.shiftright("at", 20) + b).alias("b"))
    copies = open_.join(contexts.where("c > 1").select("h", "f"), ["h", "f"]).where(left + right >= length).select("id", run(left, right).alias("run"))
    mixed = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("m")).where("k > 1 and m = 1").select("h", (F.col("k") > HOT).alias("hot"))
    compared = contexts.join(mixed, "h").select("id", "at", "c", "hot")
    per = compared.groupBy("id").agg(F.collect_list(F.struct("at", "c", "hot")).alias("marks"))
    ahead = lead + (length - lead) // 2
    behind = length - ahead + 1
    marked = texts.join(per, texts["id"].eqNullSafe(per["id"])).select(texts["id"], "text", "marks")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("id").to_pylist(), batch.column("marks").to_pylist()
            out: dict[str, list] = {"lead": [], "id": [], "at": [], "c": [], "context": []}
            for i, j, raw, offs in tb.slices(batch.column("text")):
                data = raw.tobytes()
                for k in range(i, j):
                    for m in marks[k]:
                        at, a, b = m["at"] >> 20, m["at"] >> 10 & 1023, m["at"] & 1023
                        base = int(offs[k - i]) + at
                        keys = [b"0" + data[base : base + lead]]
                        if m["hot"]:
                            keys = [b"1" + _digest(data[base : base + ahead])] if b >= ahead else []
                            keys += [b"2" + _digest(data[base - behind : base + lead])] if a >= behind else []
                        for key in keys:
                            out["lead"].append(key)
                            out["id"].append(ids[k])
                            out["at"].append(m["at"])
                            out["c"].append(m["c"])
                            out["context"].append(data[base - a : base + b])
            yield pa.RecordBatch.from_arrays([pa.array(v, batch.schema.field("id").type if n == "id" else pa.binary() if n in ("lead", "context") else pa.int64()) for n, v in out.items()], list(out))

    suffixes = stored(marked.mapInArrow(tb.tidy(cut_out), f"lead binary, id {kind}, at bigint, c bigint, context binary"))
    buckets = max(partitions(spark), suffixes.count() // BUCKET)
    crowds = stored(suffixes.where(F.col("lead") >= F.lit(b"1")).groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("lead"))
    crowded = crowds.count()  # one for each HOT suffixes at most
    usual = suffixes.join(F.broadcast(crowds), "lead", "left_anti") if crowded else suffixes

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        bucket = pa.Table.from_batches(held)
        side = np.array([x[0] for x in bucket.column("lead").to_pylist()])
        for s in np.unique(side):  # the same context may be here by both sides
            part = bucket.take(pa.array(np.flatnonzero(side == s)))
            at = part.column("at").to_numpy()
            least, greatest = repeated_offsets(part.column("context").to_pylist(), at >> 10 & 1023, length, lead)
            hit = np.flatnonzero((greatest >= 0) & (part.column("c").to_numpy() == 1))
            pos = at[hit] >> 20
            yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks().take(pa.array(hit)), pa.array(pos - greatest[hit]), pa.array(pos - least[hit] + length)], ["id", "a", "b"])

    ranged = usual.repartitionByRange(buckets, "lead").mapInArrow(tb.tidy(compare), f"id {kind}, a bigint, b bigint")
    runs = copies.unionByName(ranged.select("id", F.struct("a", "b").alias("run")))
    if crowded:
        many = suffixes.join(F.broadcast(crowds), "lead", "left_semi")
        windows = stored(many.mapInArrow(lambda batches: window_hashes(batches, length, lead), f"id {kind}, at bigint, c bigint, side int, back int, w bigint"))
        # one place of a window may be seen from two anchors, but equal windows lie alike around theirs
        again = windows.groupBy("side", "back", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("side", "back", "w")
        hits = windows.where("c = 1").join(again, ["side", "back", "w"]).groupBy("id", "at").agg(F.min("back").alias("least"), F.max("back").alias("most"))
        runs = runs.unionByName(hits.select("id", run(F.col("most"), F.lit(length) - F.col("least")).alias("run")))
    out = stored(runs.groupBy("id").agg(F.collect_list("run").alias("runs")))
    dropped(shared, open_, contexts, suffixes, crowds)
    if crowded:
        dropped(windows)
    return out


def merge(runs: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs in order, inside the text."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, r["a"]), min(size, r["b"])) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, text_col: str = "text", length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """``docs`` with n_bytes, n_removed, spans (start and end byte of each maximal removed run), kept (the remaining bytes) and kept_sha256 added.

    A column that has one of these names gives way.
    """
    columns = [c for c in docs.columns if c not in RESULTS]
    docs = stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    runs = repeated_runs(docs, "__row", text_col, length, lead).toDF("__id", "__runs")
    joined = docs.join(runs, docs["__row"] == runs["__id"], "left")
    both = joined.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.encode(F.coalesce(docs[text_col].cast("string"), F.lit("")), "UTF-8").alias("bytes"), F.col("__runs").alias("runs"))

    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("kept", pa.binary()), ("kept_sha256", pa.string())]

    @F.arrow_udf("n_bytes bigint, n_removed bigint, spans array<struct<a:bigint,b:bigint>>, kept binary, kept_sha256 string")
    def cut(data: pa.Array, marks: pa.Array) -> pa.Array:
        parts = []
        for i, j, whole, offs in tb.slices(data):
            rows = []
            raw = whole.tobytes()
            for k, found in enumerate(marks.slice(i, j - i).to_pylist()):
                own = raw[offs[k] : offs[k + 1]]
                spans = merge(found, len(own)) if found else []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(own[at:a])
                    at = b
                left = b"".join([*kept, own[at:]])
                rows.append((len(own), len(own) - len(left), [{"a": a, "b": b} for a, b in spans], left, hashlib.sha256(left).hexdigest()))
            parts.append(pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields]))
        tb.release()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))

    found = both.withColumn("own", cut("bytes", "runs"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in columns], "own.*")


def brute_force(rows: list[tuple], length: int = LENGTH) -> list[tuple]:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) by a table of every window; for tests."""
    from collections import Counter

    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        spans = merge([{"a": k, "b": k + length} for k in range(len(b) - length + 1) if seen[b[k : k + length]] > 1], len(b))
        kept, at = b"", 0
        for x, y in spans:
            kept, at = kept + b[at:x], y
        kept += b[at:]
        out.append((i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out
