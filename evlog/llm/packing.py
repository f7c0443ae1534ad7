"""Packing (8): Karmarkar-Karp multiway differencing of documents into fixed windows.

Documents become token ids where they are read. Groups of ``GROUP`` documents
are packed on their own, so nothing is shuffled and a lost task repeats alone.
Whole windows are cut from documents longer than one; what is left of each
document is cut into equal pieces of at most ``PIECE`` ids. Karmarkar-Karp
merges the partial partitions with opposing imbalances into W near-equal
windows, from the least W that can hold all ids; where a window exceeds its
capacity, W rises until none does. Windows end with padding, about half a
window for each group and one more for each rise.

Defined cases: null or empty text is the end id alone; repeated rows are packed
each for itself; an empty table gives an empty result. The same input split
gives the same packing.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog.llm import textbytes as tb

CAPACITY = 1024
GROUP = 256
#: Ids of a piece, at most, of what is left of a document: small pieces make windows nearly equal.
PIECE = 256
CACHE = 300_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: White space beyond ASCII, and separators on which regex engines differ: such texts are encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The split of byte-level BPE before merging; a fixed value of the vocabulary.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Whole texts to token ids, a slice of documents at a time.

    Before merging, byte-level BPE always splits a text where white space
    begins, before the last character of such a run and, unless that is a
    space, after it. Each distinct chunk between such places is encoded once
    per worker (up to ``CACHE`` chunks are kept); ids are then gathered by
    index. Merges run in tiktoken over the vocabulary read from the tokenizer's
    file: the same ids, for a third of the time; texts with special tokens or
    odd white space go to the tokenizer itself.
    """

    def __init__(self, path: str, end_id: int = 0):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary shows as themselves
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if i not in added}
        self.merges = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.index = np.zeros(0, np.int64)
        self.at, self.n, self.ids = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.end_id], np.uint32)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def add(self, lists: list[list[int]]) -> np.ndarray:
        """Indexes of new entries."""
        n = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(n.sum()))
        k = len(self.at)
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, flat])
        return np.arange(k, k + len(lists))

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, each with the end id; n + 1 offsets into them)."""
        if len(self.hashes) > CACHE:
            self.forget()
        docs = len(offs) - 1
        text = raw.tobytes().decode("utf-8", "surrogatepass")
        odd = np.zeros(docs, dtype=bool)
        if _ODD.search(text) or any(s in text for s in self.special):
            for d in range(docs):
                t = raw[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "surrogatepass")
                odd[d] = bool(_ODD.search(t)) or any(s in t for s in self.special)
        space = np.append(_SPACE[raw], False)
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offs] = True
        before = np.concatenate([[False], space[:-1]]) & ~edge  # white space goes on from before, in the same text
        run = space & ~before
        after = np.append(space[1:], False)
        after[offs[1:] - 1] = True  # a run that ends its text stays whole
        last = space & ~after
        cut = run | last | edge
        cut[1:] |= last[:-1] & (raw != 32)
        cut = np.flatnonzero(cut[:-1])
        ends = np.append(cut[1:], len(raw))
        first = np.searchsorted(cut, offs)
        hashes = tb.span_hashes(raw, cut, ends, tb.BYTE64)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        k = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        known = self.hashes[k] == distinct if len(self.hashes) else np.zeros(len(distinct), dtype=bool)
        got = np.zeros(len(distinct), np.int64)
        got[known] = self.index[k[known]]
        data, encode = raw.tobytes(), self.merges.encode_ordinary
        a, b = cut[where[~known]].tolist(), ends[where[~known]].tolist()
        got[~known] = self.add([encode(data[i:j].decode("utf-8", "surrogatepass")) for i, j in zip(a, b, strict=True)])
        merged = np.concatenate([self.hashes, distinct[~known]])
        order = np.argsort(merged, kind="stable")
        self.hashes, self.index = merged[order], np.concatenate([self.index, got[~known]])[order]
        which = got[back]
        count = np.diff(first)
        if odd.any():
            keep = ~np.repeat(odd, count)
            at = np.flatnonzero(odd)
            own = self.add([self.whole(data[offs[d] : offs[d + 1]].decode("utf-8", "surrogatepass")) for d in at])
            count = np.where(odd, 0, count)
            which = np.insert(which[keep], np.cumsum(count)[at] , own)
            count[at] = 1
        which = np.insert(which, np.cumsum(count), 0)  # the end id is entry 0
        n = self.n[which]
        ids = self.ids[tb.spread(self.at[which], n)]
        total = np.cumsum(np.append(0, n))
        return ids, total[np.append(0, np.cumsum(count + 1))]


def differencing(sizes: list[int], bins: int) -> list[int]:
    """The bin of each item by Karmarkar-Karp multiway differencing; ties go to the earlier item.

    A partial partition is a vector of bin sums in falling order. The two with
    the largest spread are merged, largest bin on smallest, until one is left;
    the orders in which bins met are then replayed from the top.
    """
    if not sizes:
        return []
    if bins <= 1:
        return [0] * len(sizes)
    nodes: list = []  # item index, or (left, right, order after the merge)
    heap = []
    for i, s in enumerate(sizes):
        v = np.zeros(bins, dtype=np.int64)
        v[0] = s
        heap.append((-s, i, v))
        nodes.append(i)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, va = heapq.heappop(heap)
        _, b, vb = heapq.heappop(heap)
        v = va + vb[::-1]
        order = np.argsort(-v, kind="stable")
        v = v[order]
        v = v - v[-1]
        nodes.append((a, b, order))
        heapq.heappush(heap, (-int(v[0]), len(nodes) - 1, v))
    out = [0] * len(sizes)
    stack = [(heap[0][1], np.arange(bins))]
    while stack:
        k, place = stack.pop()  # place[p]: the final bin of this node's p-th bin
        node = nodes[k]
        if isinstance(node, int):
            out[node] = int(place[0])
        else:
            a, b, order = node
            at = np.empty(bins, dtype=np.int64)
            at[order] = place
            stack += [(a, at), (b, at[::-1])]
    return out


def pack(lengths: list[int], capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in it, length, window, offset there) of a group; every id lies in one piece."""
    out: list[tuple[int, int, int, int, int]] = []
    window = 0
    rest: list[tuple[int, int, int]] = []
    for i, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            out.append((i, at, capacity, window, 0))
            at += capacity
            window += 1
        for left in range(-(-(n - at) // piece), 0, -1):
            own = (n - at) // left
            rest.append((i, at, own))
            at += own
    sizes = np.array([x[2] for x in rest], dtype=np.int64)
    bins = -(-int(sizes.sum()) // capacity)
    while rest:
        where = differencing(sizes.tolist(), bins)
        if np.bincount(where, weights=sizes).max() <= capacity:
            break
        bins += 1  # a window exceeds its capacity
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    for x, b in zip(rest, where if rest else [], strict=True):
        held[b].append(x)
    for b in held:
        offset = 0
        for i, at, n in b:
            if offset and out[-1][0] == i and out[-1][1] + out[-1][2] == at:  # pieces of one document that meet again
                out[-1] = (i, out[-1][1], out[-1][2] + n, window, out[-1][4])
            else:
                out.append((i, at, n, window, offset))
            offset += n
        window += 1
    return out


def rebatched(batches: Iterator[pa.RecordBatch], rows: int, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``; fewer where their texts are over ``limit`` bytes, or at the end."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        _, offs = tb.utf8(batch.column("text"))
        i = 0
        while i < batch.num_rows:
            fit = int(np.searchsorted(offs, offs[i] + limit - size, side="right")) - 1
            j = min(max(i + 1, fit), i + rows - n, batch.num_rows)
            held.append(batch.slice(i, j - i))
            n, size, i = n + j - i, size + int(offs[j] - offs[i]), j
            if n >= rows or size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pack_documents(docs: DataFrame, tokenizer: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP, end_id: int = 0, piece: int = PIECE) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``tokenizer``: a path, or a function that gives it on the worker."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder(tokenizer if isinstance(tokenizer, str) else tokenizer(), end_id)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in rebatched(batches, group):
            keys = batch.column("id")
            raw, offs = tb.utf8(batch.column("text"))
            ids, at = encoder.encode(raw, offs)
            pieces = np.array(pack(np.diff(at).tolist(), capacity, piece), dtype=np.int64).reshape(-1, 5)
            doc, start, length, window, offset = pieces.T
            data = ids.astype("<u4", copy=False).view(np.uint8)
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((at[doc] + start).tolist(), (at[doc] + start + length).tolist(), strict=True)]
            columns = [keys.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.diff(at)[doc]), pa.array(base + window), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            base += int(window.max(initial=-1)) + 1

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(tb.tidy(run), f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
        .withColumnRenamed("id", id_col)
    )
