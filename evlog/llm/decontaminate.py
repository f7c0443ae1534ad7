"""Benchmark decontamination (7): training suffix arrays, searched for every test suffix.

Each shard (a slice of documents) gets a suffix array over its words, which
holds the suffixes whose first two words begin some test window, sorted to the
window's depth. Every distinct test window is binary-searched in it, one word
of depth at a time; the range that is left after ``window`` words holds all
places of that window. Places that follow each other in the same item are one
longer match: the operator gives the longest verbatim matches of each item,
with their locations in the document and in the item.

A shard is searched where it is read: documents are not shuffled. The test
items are sent to the workers in blocks of ``block_bytes``; more items mean
more passes over a written table with row numbers, whose spans meet by row.

Defined cases: null or empty text has no words and is not hit; an item without
words is skipped; an item shorter than the window is one window of its own
length; items with a null id are one item, which counts in n_hit and n_items and
is left out of items_sha256; repeated documents or items count each for itself; an empty benchmark
hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog.llm import textbytes as tb
from evlog.llm.sparkio import stored

WINDOW = 10
#: Bytes of items that are searched for in one pass; a worker holds some six times as much.
BLOCK_BYTES = 16 << 20


class TestSuffixes:
    """The windows of a block of items, each distinct one once, as places in one sequence of word hashes."""

    def __init__(self, texts: list[str], window: int = WINDOW):
        raw, offs = tb.utf8(pa.array(texts, pa.large_string()))
        starts, ends, first = tb.word_spans(raw, offs, tb.ALNUM)
        self.words = np.append(tb.span_hashes(raw, starts, ends), np.zeros(window, np.uint64))
        counts = np.diff(first)
        size = np.minimum(counts, window)
        n = np.where(counts > 0, counts - size + 1, 0)
        at = tb.spread(first[:-1], n)
        item = np.repeat(np.arange(len(texts)), n).astype(np.int32)
        length = size[item] if len(texts) else np.zeros(0, np.int64)
        key = length.astype(np.uint64)
        for k in range(window):
            key = np.where(k < length, tb.mix64(key * tb.U(0x9FB21C651E98DF25) + self.words[np.minimum(at + k, len(self.words) - 1)]), key)
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else np.zeros(0, np.int64)
        self.at, self.length = at[order][new], length[order][new]
        # the places of each distinct window: its items, and where in them
        self.places, self.item = np.append(new, len(order)), item[order]
        self.offset = (at[order] - first[:-1][self.item]).astype(np.int32) if len(texts) else np.zeros(0, np.int32)
        self.window = window
        self.single = np.unique(self.words[self.at[self.length == 1]])
        more = self.at[self.length > 1]
        self.pairs = np.unique(tb.fold(self.words[more], self.words[more + 1])) if len(more) else np.zeros(0, np.uint64)

    def find(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct window, word position) of every place of every window in the shard's words."""
        none = np.zeros(0, np.int64)
        if not len(words) or not len(self.at):
            return none, none
        nxt = np.append(words[1:], np.uint64(0))
        last = first[1:][np.diff(first) > 0] - 1
        nxt[last] = 0
        keep = np.zeros(len(words), dtype=bool)
        if len(self.pairs):
            keep = _among(tb.fold(words, nxt), self.pairs)
        if len(self.single):
            keep |= _among(words, self.single)
        start = np.flatnonzero(keep)
        if not len(start):
            return none, none
        doc_end = first[np.searchsorted(first, start, side="right")]
        at = start[:, None] + np.arange(self.window)
        suffix = np.append(words, np.zeros(self.window, np.uint64))[at]
        suffix[at >= doc_end[:, None]] = 0
        order = np.lexsort(suffix.T[::-1])
        suffix, start = suffix[order], start[order]
        lo = np.zeros(len(self.at), np.int64)
        hi = np.full(len(self.at), len(start))
        for depth in range(self.window):
            live = (depth < self.length) & (lo < hi)
            column, want = suffix[:, depth], self.words[self.at[live] + depth]
            lo[live], hi[live] = _bound(column, want, lo[live], hi[live], False), _bound(column, want, lo[live], hi[live], True)
        n = np.maximum(hi - lo, 0)
        return np.repeat(np.arange(len(n)), n), start[tb.spread(lo, n)]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``known``: a bitmap sorts out nearly all, a binary search decides."""
    bitmap = np.zeros(1 << 20, dtype=bool)
    bitmap[(known >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(bitmap[(values >> np.uint64(44)).astype(np.int64)])
    out = np.zeros(len(values), dtype=bool)
    found = known[np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)] == values[maybe]
    out[maybe[found]] = True
    return out


def _bound(column: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each wanted word in its own range [lo, hi) of the column, sorted there."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        x = column[np.minimum(mid, len(column) - 1)]
        up = open_ & ((x <= want) if right else (x < want))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)].tolist()


def verbatim(item: np.ndarray, offset: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, place in it, place in the document, length) of the longest matches that windows (of these columns) make up."""
    order = np.lexsort((at, at - offset, item))
    item, offset, at, length = item[order], offset[order], at[order], length[order]
    goes_on = (np.diff(item) == 0) & (np.diff(at) == 1) & (np.diff(offset) == 1)
    first = np.flatnonzero(np.append(True, ~goes_on))
    last = np.append(first[1:], len(at)) - 1
    return item[first], offset[first], at[first], at[last] + length[last] - at[first]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list[str | None], list[str]]]:
    """(ids as strings, texts) of the items, at most about ``block_bytes`` of text at once on the driver."""
    ids: list[str] = []
    texts: list[str] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    for row in rows.toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t)
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


_MATCHES = pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))


def matches(docs: DataFrame, ids: list[str | None], texts: list[str], window: int) -> DataFrame:
    """Per row of (row, id, text): n_words, merged hit spans (first word, end word), the ids of the items found and their longest matches."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"row bigint, id {kind}, n_words bigint, span_from array<bigint>, span_to array<bigint>, items array<string>, matches array<struct<item: string, item_start: bigint, start: bigint, length: bigint>>"
    shared = docs.sparkSession.sparkContext.broadcast((TestSuffixes(texts, window), ids))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, names = shared.value
        for batch in batches:
            for i, j, raw, offs in tb.slices(batch.column("text")):
                starts, ends, first = tb.word_spans(raw, offs, tb.ALNUM)
                test, at = tests.find(tb.span_hashes(raw, starts, ends), first)
                froms, tos, items, found = ([[] for _ in range(j - i)] for _ in range(4))
                doc = np.searchsorted(first, at, side="right") - 1
                order = np.argsort(doc, kind="stable")
                test, at, doc = test[order], at[order], doc[order]
                cuts = [*np.flatnonzero(np.diff(doc, prepend=-1)).tolist(), len(doc)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    d, here, own = int(doc[a]), test[a:b], at[a:b] - first[doc[a]]
                    froms[d], tos[d] = _merge(own, own + tests.length[here])
                    n = tests.places[here + 1] - tests.places[here]
                    place = tb.spread(tests.places[here], n)
                    run = verbatim(tests.item[place], tests.offset[place], np.repeat(own, n), np.repeat(tests.length[here], n))
                    items[d] = sorted({names[k] for k in np.unique(run[0])}, key=lambda x: (x is None, x or ""))
                    found[d] = [{"item": names[k], "item_start": o, "start": s, "length": z} for k, o, s, z in zip(*(x.tolist() for x in run), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, j - i), batch.column("id").slice(i, j - i), pa.array(np.diff(first)), *(pa.array(x, pa.list_(pa.int64())) for x in (froms, tos)), pa.array(items, pa.list_(pa.string())), pa.array(found, _MATCHES)],
                    ["row", "id", "n_words", "span_from", "span_to", "items", "matches"],
                )

    return docs.mapInArrow(tb.tidy(search), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match (words of its longest verbatim match with an item) and matches (item, item_start, start, length of each).

    With several blocks of items, the documents are written once with a row number, by which the hit spans of the passes are united.
    """
    rows = docs.select(F.lit(0).cast("bigint").alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes)
    now, more = next(blocks, ([], [])), next(blocks, None)
    if more is None:
        found = matches(rows, *now, window)
        sizes = F.zip_with("span_to", "span_from", lambda b, a: b - a)
        found = found.withColumn("n_hit", F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x))
    else:
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
        passes = [stored(matches(rows, *now, window))]
        while more is not None:
            passes.append(stored(matches(rows, *more, window).where(F.size("items") > 0)))
            more = next(blocks, None)
        found = reduce(DataFrame.unionByName, passes)
        joined = lambda c: F.flatten(F.collect_list(c))
        found = found.groupBy("row", "id").agg(F.max("n_words").alias("n_words"), joined("span_from").alias("span_from"), joined("span_to").alias("span_to"), F.array_sort(F.array_distinct(joined("items"))).alias("items"), joined("matches").alias("matches"))
        start = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("end"))
        reach = F.aggregate(
            F.array_sort(F.arrays_zip("span_from", "span_to")),
            start,
            lambda a, s: F.struct((a.hit + F.greatest(s.span_to - F.greatest(s.span_from, a.end), F.lit(0))).alias("hit"), F.greatest(a.end, s.span_to).alias("end")),
        )
        found = found.withColumn("n_hit", reach.getField("hit"))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m.length)), F.lit(0)).cast("bigint")
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), longest.alias("longest_match"), "matches"
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract, word by word; for tests."""
    import re

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    tests = [(str(i), [tuple(w[k : k + min(window, len(w))]) for k in range(len(w) - min(window, len(w)) + 1)]) for i, t in items if (w := words(t))]
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, windows in tests:
            for win in windows:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        found.add(item)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
