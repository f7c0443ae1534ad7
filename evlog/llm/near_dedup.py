"""MinHash near-dedup (9): bottom-k sketches of one hash function.

1. Every document's set of word shingles is hashed with one function; the k
   smallest values are its sketch (a set of at most k is its own sketch). Equal
   sets form a class; its smallest id stands for it from here on, so copies
   cost nothing further.
2. Inverted lists of retained values: values are ordered rare first over the
   whole corpus, and each sketch enters the lists of its rarest values, with the
   place of the value in that order. Of whole sets, as many as the threshold
   makes necessary enter; of cut ones, ``k - t + 1``, as two sets at the
   threshold share t retained values at least but for a chance of ``MISS``.
   A linked pair thus meets in the list of its first common value.
3. A list of at most ``SHORT`` members gives all its pairs, so that their number
   grows with the rows. Before that, members of longer lists meet by
   their whole sets: values are ordered rare first among them, each set enters
   the lists of as many of its rarest values as the threshold makes necessary,
   and two sets that have too few values left from there on, or whose parity
   bitmaps differ in more bits than the threshold lets two sets differ in
   values, are no pair. Both bounds are exact. In these lists one pivot is
   compared with the members that aren't in its component yet, for
   ``PIVOT_ROUNDS`` rounds, so that a group of m near copies costs about m
   comparisons; then all pairs that are left come up. Of the pairs that come up,
   one partner of each member is verified first, then two of what is still
   apart, four and so on, and the rest at once when no more is left than was
   verified. No pair is left out: it is compared, already linked, or beyond a
   bound.
4. A pair goes through the size bound, the positional bound, the estimate from
   the sketch of its union, and the exact Jaccard test on both full sets.
5. Components are found in one task up to a bound of edges, beyond it by star
   contraction; nothing of it is on the driver.

Defined cases: null or empty text, or text without words, is an empty set,
linked with nothing and kept; with fewer words than a shingle has, the whole
sequence is one shingle; repeated rows are one class; of one id with several
texts, each text is a class of its own; rows with a null id are classed and
linked as all others, but their id is never the smallest (a component of such
rows only has a null id, and all of them are kept). Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evlog.llm import textbytes as tb
from evlog.llm.components import components
from evlog.llm.sparkio import dropped, partitions, stored

SKETCH = 192
#: Sets of at most this share of k are compared as whole sets.
WHOLE = 0.95
MISS = 1e-9
#: Members of a list whose pairs are all compared at once.
SHORT = 16
#: Bits of a set's parity bitmap, as 64-bit words.
WORDS = 8
#: Members of a pivot that one task compares; more are dealt to several.
SALT = 256
#: Rows of ids and hashes (40 bytes at most) sent to all workers at once; beyond it, the join shuffles.
BROADCAST_IDS = 400_000
PIVOT_ROUNDS = 3
_BITMAP = [f"w{i}" for i in range(WORDS)]


def least_overlap(threshold: float, k: int = SKETCH, miss: float = MISS) -> int:
    """The largest t with P(fewer than t of k retained values are shared) <= miss at the threshold."""
    total, t = 0.0, 0
    while t < k:
        total += math.comb(k, t) * threshold**t * (1 - threshold) ** (k - t)
        if total > miss:
            break
        t += 1
    return max(1, t)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each document, sorted as signed integers."""
    starts, ends, first = tb.word_spans(raw, offs, tb.NONSPACE)
    words = tb.span_hashes(raw, starts, ends)
    rolled = tb.fold(*[words[i : len(words) - width + 1 + i] for i in range(width)]).view(np.int64) if len(words) >= width else np.zeros(0, np.int64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append((tb.fold(*[words[i : i + 1] for i in range(a, b)]) ^ np.uint64(b - a)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): what tells a class's representative from other rows is its id and the hash of its text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("id", F.xxhash64("text").alias("th"), "text")


def bounded(rows: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A stored frame of narrow rows, marked to be broadcast only if it has at most ``limit`` of them."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, k: int = SKETCH) -> DataFrame:
    """Per row: id, th (hash of the text), n (set size), fp (digest of the set) and its sketch (the upper halves of its k smallest hashes)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offs in tb.slices(batch.column("text")):
                sets = shingle_sets(raw, offs, width)
                low = [np.unique((s >> 32).astype(np.int32))[:k] for s in sets]
                flat = pa.array(np.concatenate(low) if low else np.zeros(0, np.int32))
                ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)],
                    ["id", "th", "n", "fp", "sketch"],
                )

    return identified(docs, id_col, text_col).mapInArrow(tb.tidy(run), f"id {kind}, th bigint, n bigint, fp binary, sketch array<int>")


def inverted_lists(classes: DataFrame, threshold: float, k: int = SKETCH) -> tuple[DataFrame, DataFrame]:
    """(v, id, n, pos): the lists over each sketch's rarest values, those of at most ``SHORT`` members and the others.

    pos is the value's place in its sketch.
    """
    share = least_overlap(threshold, k) / k
    values = classes.select("id", F.explode("sketch").alias("v"))
    frequent = stored(values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SHORT))
    known = bounded(frequent)
    own = values.join(known, "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("frequent"))  # at most k of a sketch
    ordered = F.when(F.col("frequent").isNull(), F.col("sketch")).otherwise(F.concat(F.array_except("sketch", F.col("frequent.v")), F.col("frequent.v")))
    size = F.size("sketch")
    prefix = F.when(F.col("n") <= WHOLE * k, F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).otherwise(size - F.ceil(size * share) + 1)
    rare = size - F.coalesce(F.size("frequent"), F.lit(0))  # values from here on are frequent
    lists = classes.join(own, "id", "left").select("id", "n", rare.alias("rare"), F.posexplode(F.slice(ordered, F.lit(1), F.least(size, prefix).cast("int"))).alias("pos", "v"))
    lists = stored(lists.select("v", "id", "n", "pos", (F.col("pos") >= F.col("rare")).alias("often")))
    counts = stored(lists.where("often").groupBy("v").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > SHORT).select("v"))
    often = lists.where("often").drop("often")
    long = often.join(bounded(counts), "v", "left_semi")
    short = lists.where("not often").drop("often").unionByName(often.join(bounded(counts), "v", "left_anti"))
    dropped(frequent)
    return short, long


def list_pairs(short: DataFrame, threshold: tuple[int, int], k: int = SKETCH) -> DataFrame:
    """(a, b) of all pairs of members of one list within the bounds; at most ``SHORT`` members are gathered."""
    lists = short.groupBy("v").agg(F.collect_list(F.struct("id", "n", "pos")).alias("all")).where(F.size("all") > 1)
    one = lists.select("all", F.explode("all").alias("x"))
    two = one.select("x", F.explode(F.filter("all", lambda y: y.id > F.col("x.id"))).alias("y"))
    pairs = two.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.col("x.pos").alias("pa"), F.col("y.pos").alias("pb"))
    return pairs.where(possible(threshold, k)).select("a", "b").distinct()


def whole_lists(texts: DataFrame, threshold: tuple[int, int], width: int) -> DataFrame:
    """(v, id, n, pos and the bitmap's words): the lists of two members or more over the rarest values of whole sets."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offs in tb.slices(batch.column("text")):
                sets = shingle_sets(raw, offs, width)
                odd = np.array([np.bincount((s & (64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1 for s in sets], dtype=np.uint8)
                words = np.packbits(odd, axis=1, bitorder="little").view(np.int64)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), values, *map(pa.array, words.T)], ["id", "n", "set", *_BITMAP])

    sets = stored(texts.select("id", "text").mapInArrow(tb.tidy(run), f"id bigint, n bigint, set array<bigint>, {', '.join(f'{w} bigint' for w in _BITMAP)}"))
    values = sets.select("id", F.explode("set").alias("v"))
    shared = stored(values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    own = values.join(bounded(shared), "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("all"))
    alone = F.col("n") - F.size("all")  # values of no other set come first in the order
    prefix = F.col("n") - F.ceil(F.col("n") * num / den - 1e-9) + 1 - alone
    first = F.slice(F.col("all.v"), F.lit(1), F.greatest(prefix, F.lit(0)).cast("int"))
    lists = sets.drop("set").join(own, "id").select("id", "n", *_BITMAP, alone.alias("alone"), F.posexplode(first).alias("i", "v"))
    out = stored(lists.select("v", "id", "n", (F.col("alone") + F.col("i")).alias("pos"), *_BITMAP))
    dropped(sets, shared)
    return out


def possible(threshold: tuple[int, int], k: int = SKETCH) -> Column:
    """The size bound, and for two whole sets the positional one: what both have left from here on must be enough."""
    num, den = threshold
    sizes = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    whole = F.greatest("na", "nb") <= WHOLE * k
    return sizes & (~whole | (left * (num + den) >= (F.col("na") + F.col("nb")) * num))


def similar(pairs: DataFrame, classes: DataFrame, threshold: tuple[int, int], k: int = SKETCH) -> DataFrame:
    """The pairs (a, b) that the sketch of their union lets through; of whole sets, a sharp bound."""
    num, den = threshold
    share = least_overlap(num / den, k) / k
    one, two = (classes.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb"))
    whole = (F.greatest("na", "nb") <= WHOLE * k) & (F.size(F.array_union("sa", "sb")) <= k)
    bound = F.when(whole, (F.size("u") * num) / den - 2).otherwise(F.size("u") * share)  # 2: values that fall together by chance
    return both.withColumn("u", union).where(shared >= bound).select("a", "b")


def verified(near: DataFrame, count: int, texts: DataFrame, threshold: tuple[int, int], width: int) -> DataFrame:
    """The pairs (a, b), ``count`` of them, with den * |intersection| >= num * |union|, by their full sets."""
    num, den = threshold
    degrees = near.groupBy("a").agg(F.count(F.lit(1)).alias("d")).withColumn("s", F.ceil(F.col("d") / SALT).cast("int"))
    members = near.join(degrees, "a").select("a", F.pmod(F.xxhash64("b"), F.col("s")).cast("int").alias("s"), F.lit(False).alias("pivot"), F.col("b").alias("id"))
    pivots = degrees.select("a", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("s"), F.lit(True).alias("pivot"), F.col("a").alias("id"))
    wanted = members.unionByName(pivots)
    if count * 2 <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = texts.join(wanted, "id").repartition(partitions(near.sparkSession), "a", "s").sortWithinPartitions("a", "s", F.desc("pivot"))
    kind = rows.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot = None, np.zeros(0, np.int64)
        for batch in batches:
            at = list(zip(batch.column("a").to_pylist(), batch.column("s").to_pylist(), strict=True))
            first = batch.column("pivot").to_pylist()
            good = []
            for i, j, raw, offs in tb.slices(batch.column("text")):
                for x, own in enumerate(shingle_sets(raw, offs, width), i):
                    if first[x]:
                        key, pivot = at[x], own
                        continue
                    assert at[x] == key
                    shared = len(np.intersect1d(pivot, own, assume_unique=True))
                    if den * shared >= num * (len(pivot) + len(own) - shared):
                        good.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good, pa.int64())), batch.column("id").take(pa.array(good, pa.int64()))], ["a", "b"])

    return rows.select("a", "s", "pivot", "id", "text").mapInArrow(tb.tidy(run), f"a {kind}, b {kind}")


def within(threshold: tuple[int, int]) -> Column:
    """The bounds of whole sets: size, place, and the parity bitmaps, which differ in no more bits than the sets in values."""
    num, den = threshold
    total = F.col("na") + F.col("nb")
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in _BITMAP])
    return (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (left * (num + den) >= total * num) & (bits * (num + den) <= total * (den - num))


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs (a, b) that are in different components so far."""
    if labels is None:
        return pairs
    at = labels.select("id", "comp")
    both = pairs.join(at.withColumnsRenamed({"id": "a", "comp": "x"}), "a", "left").join(at.withColumnsRenamed({"id": "b", "comp": "y"}), "b", "left")
    return both.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def merged(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The components of the links and of those known so far."""
    if labels is None:
        return components(links)
    return components(links.unionByName(labels.select(F.col("id").alias("a"), F.col("comp").alias("b"))))


def linked(near: DataFrame, labels: DataFrame | None, texts: DataFrame, threshold: tuple[int, int], width: int) -> DataFrame | None:
    """Components after every one of the pairs is verified or joined by others.

    One partner of each member is verified first, then two of what is still
    apart, four and so on: a group of m near copies costs about m comparisons.
    As soon as no more pairs are left than were verified, all of them are, so
    that a few pairs don't take rounds of their own.
    """
    left, partners, done = near, 1, 0
    while waiting := left.count():
        chosen, n = left, waiting
        if waiting > done:
            few = left.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("a"))).where(F.col("r") <= partners).select("a", "b")
            chosen = stored(few)
            n = chosen.count()
        labels = merged(verified(chosen, n, texts, threshold, width), labels)
        rest = stored(apart(left.join(chosen, ["a", "b"], "left_anti"), labels)) if n < waiting else None
        dropped(*([chosen] if chosen is not left else []), *([left] if left is not near else []))
        if rest is None:
            break
        left, partners, done = rest, 2 * partners, done + n
    return labels


def closed(lists: DataFrame, labels: DataFrame | None, classes: DataFrame, texts: DataFrame, threshold: tuple[int, int], width: int, k: int) -> DataFrame | None:
    """Components after all that meet in these lists are compared: pivots first, then all pairs that are still apart."""
    side = lambda x: {c: f"{x}{c}" for c in _BITMAP} | {"id": x, "n": f"n{x}", "pos": f"p{x}", "comp": f"c{x}"}
    for tried in range(PIVOT_ROUNDS + 1):
        marked = stored(labelled(lists, labels))
        per = marked.groupBy("v").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("v")
        open_ = marked.join(per, "v", "left_semi")
        two = open_.withColumnsRenamed(side("b"))
        open_pair = (F.col("ca") != F.col("cb")) & within(threshold)
        if tried < PIVOT_ROUNDS:
            first = F.xxhash64("id", F.lit(tried))
            pivot = open_.groupBy("v").agg(F.min(F.struct(first.alias("h"), *[F.col(c).alias(x) for c, x in side("a").items()])).alias("p")).select("v", "p.*")
            pairs = two.join(pivot, "v").where(open_pair)
        else:
            pairs = open_.withColumnsRenamed(side("a")).join(two, "v").where((F.col("a") < F.col("b")) & open_pair)
        near = stored(similar(pairs.select("a", "b").distinct(), classes, threshold, k))
        dropped(marked)
        if near.isEmpty():
            if tried == PIVOT_ROUNDS:
                return labels
            continue
        if tried == PIVOT_ROUNDS:
            return linked(near, labels, texts, threshold, width)
        # of a pivot round, one partner for each member will do: what stays apart comes up again
        chosen = stored(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        labels = merged(verified(chosen, chosen.count(), texts, threshold, width), labels)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (8, 10), k: int = SKETCH) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable) and kept (it is its component's)."""
    num, den = threshold
    rows = stored(sketches(docs, id_col, text_col, width, k))
    members = stored(rows.select("id", "n", "fp"))
    key = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("own"), "th")
    found = rows.where("n > 0").groupBy("fp").agg(F.min(key).alias("r"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(found.select(F.monotonically_increasing_id().alias("id"), "fp", "r.own", "r.th", "n", "sketch"))
    dropped(rows)
    short, long = inverted_lists(classes.select("id", "n", "sketch"), num / den, k)
    pairs = stored(list_pairs(short, threshold, k))
    crowd = stored(long.select("id").distinct())
    met = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowd.select("id")).distinct())
    own = classes.join(bounded(met), "id", "left_semi")
    active = stored(own.select("id", "n", "sketch"))
    names = stored(own.select("id", "own", "th"))
    texts = identified(docs, id_col, text_col).withColumnRenamed("id", "_own").withColumnRenamed("th", "_th").join(bounded(names), (F.col("own").eqNullSafe(F.col("_own"))) & (F.col("th") == F.col("_th")))
    texts = stored(texts.select("id", "text"))
    labels = None
    if not crowd.isEmpty():  # first, so that large groups are one component when the short lists' pairs come up
        lists = whole_lists(texts.join(bounded(crowd), "id", "left_semi"), threshold, width)
        labels = closed(lists, labels, active, texts, threshold, width, k)
        dropped(lists)
    near = stored(similar(apart(pairs, labels), active, threshold, k))
    labels = linked(near, labels, texts, threshold, width)
    dropped(pairs, near, crowd, met, active, names, texts)
    known = classes.select("fp", "own", F.col("id").alias("key"))
    if labels is None:
        known = known.select("fp", F.col("own").alias("least"))
    else:
        known = known.join(labels.withColumnsRenamed({"id": "key"}), "key", "left")
        least = known.where("comp is not null").groupBy("comp").agg(F.min("own").alias("m"))
        known = known.join(least, "comp", "left").select("fp", F.when(F.col("comp").isNull(), F.col("own")).otherwise(F.col("m")).alias("least"))
    out = members.join(known, "fp", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.when(F.col("component_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))
