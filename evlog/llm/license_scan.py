"""License scans (3), with DataFrame functions only: an exact set-similarity join of text blocks with templates.

A block is a line with the one after it (the last line is one alone), so that a
template wrapped over a line break is found. A template is found in a block
where at least ``THRESHOLD`` of the template's distinct words are among the
block's. Template words are
ordered by their frequency over the whole corpus, rare first. With ``need``
words to be shared of a template's m, one of its first m - need + 1 words must
be in the block (prefix filter), the block must have ``need`` template words
(length filter), and from the first shared word on both sides must have enough
words left (positional filter). What passes is counted in full, so the result
is exact. Templates are a parameter: the side that is broadcast has one row for
each template word of a prefix. A first pass notes which template words each
document has, for the frequencies; documents without any prefix word are never
split into blocks.

Besides, phrases are counted where their words stand consecutively.

Defined cases: null or empty text has no words, no place and score 0; rows with
equal id and text get equal results; first_word and last_word are null where
there is no place; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog.llm.sparkio import stored

#: Phrases and their labels: fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: (label, words of a typical line). The usual wording of public licenses.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("reserved", "copyright all rights reserved"),
)
THRESHOLD = 0.8
BLOCK_LINES = 2
#: Keys of candidate documents that are sent to all workers at most; beyond it, the join shuffles.
BROADCAST_KEYS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case. ``lower`` is much faster than ``translate``, and differs for ASCII words in two characters only."""
    text = F.coalesce(text, F.lit(""))
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a lower-case text, each with a space before and after; one space where there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), _BETWEEN, " ")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def phrase_columns(text: Column, phrases: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base (array of labels) of a text of ``words``."""
    n = _spaces(text) - 1
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        whole, size = f" {phrase} ", phrase.count(" ") + 1
        here = F.contains(text, F.lit(whole))
        counts.append(F.when(here, F.regexp_count(text, F.lit(f" {phrase}(?= )"))).otherwise(0).cast("bigint"))
        firsts.append(F.when(here, _spaces(F.substring_index(text, whole, 1))))
        lasts.append(F.when(here, n - _spaces(F.substring_index(text, whole, -1)) - size))
        labels.append(F.when(here, F.lit(label)))
    return {
        "n_words": n,
        "n_base": reduce(lambda a, b: a + b, counts),
        "first_word": F.least(*firsts) if len(firsts) > 1 else firsts[0],
        "last_word": F.greatest(*lasts) if len(lasts) > 1 else lasts[0],
        "base": F.array_compact(F.array(*labels)),
    }


def template_matches(rows: DataFrame, seen: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """(key, block, label, containment) of every block that meets a template; ``rows`` has key and text, ``seen`` key and the template words that the text has."""
    spark = rows.sparkSession
    counts = {r.w: r.c for r in seen.select(F.explode("has").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")).collect()}
    index, vocabulary = [], sorted({w for _, t in templates for w in t.split()}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    for k, (label, t) in enumerate(templates):
        own = sorted({rank[w] for w in t.split()})
        need = math.ceil(threshold * len(own) - 1e-9)
        index += [(r, k, label, i, own, need) for i, r in enumerate(own[: len(own) - need + 1])]
    by_word = spark.createDataFrame(index, "first int, template int, label string, i int, own array<int>, need int")
    prefix = sorted({vocabulary[r[0]] for r in index})
    near = seen.where(F.arrays_overlap("has", F.array(*map(F.lit, prefix)))).select("key").distinct()
    if near.count() <= BROADCAST_KEYS:
        near = F.broadcast(near)
    ranks = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    known = lambda line: F.filter(F.transform(F.split(words(line), " "), lambda w: F.element_at(ranks, w)), lambda r: r.isNotNull())
    lines = F.transform(F.split(lowered(F.col("text")), "\n"), lambda line: F.array_distinct(known(line)))
    two = once(lines, lambda all_: F.transform(all_, lambda _, i: F.array_sort(F.array_distinct(F.flatten(F.slice(all_, i + 1, F.lit(BLOCK_LINES)))))))
    blocks = rows.join(near, "key", "left_semi").select("key", F.posexplode(two).alias("block", "have")).where(F.size("have") > 0)
    pairs = blocks.select("key", "block", "have", F.posexplode("have").alias("j", "first")).join(F.broadcast(by_word), "first")
    pairs = pairs.where((F.size("have") >= F.col("need")) & (F.size("own") - F.col("i") >= F.col("need")) & (F.size("have") - F.col("j") + F.least("i", "j") >= F.col("need")))
    shared = F.size(F.array_intersect("have", "own"))
    return pairs.where(shared >= F.col("need")).select("key", "block", "label", (shared / F.size("own")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best containment; 1 with a phrase) and n_blocks."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, t in templates for w in t.split()})])
    facts = once(words(lowered(F.col("text"))), lambda t: F.struct(*[c.alias(k) for k, c in phrase_columns(t, phrases).items()], F.filter(vocabulary, lambda w: F.contains(t, F.concat(F.lit(" "), w, F.lit(" ")))).alias("has")))
    base = stored(rows.select("id", "key", facts.alias("facts"))).select("id", "key", "facts.*")
    found = template_matches(rows.select("key", "text"), base.select("key", "has"), templates, threshold)
    found = found.groupBy("key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"), F.countDistinct("block").alias("n_blocks"))
    out = base.join(found, "key", "left")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    nothing = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("found", nothing))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("bigint").alias("n_blocks"),
    )


def oracle_sql(phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL: every block against every template, word list against word list."""
    low = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    places = " + ".join(f"len(p{i})" for i in range(len(phrases)))
    cases = ", ".join(
        f"list_filter(range(1, len(w) - {p.count(" ")} + 1), lambda i: " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + f") as p{i}" for i, (p, _) in enumerate(phrases)
    )
    base = "list_filter([" + ", ".join(f"case when len(p{i}) > 0 then '{label}' end" for i, (_, label) in enumerate(phrases)) + "], lambda x: x is not null)"
    values = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))})" for k, (label, t) in enumerate(templates))
    everywhere = "flatten([" + ", ".join(f"p{i}" for i in range(len(phrases))) + "])"
    return f"""
with d as (select doc_id, {low} as t from documents),
w as (select doc_id, t, regexp_extract_all(t, {word}) as w from d),
b as (select doc_id, w, {cases} from w),
cut as (select doc_id, string_split(t, chr(10)) as l from d),
blocks as (select doc_id, list_distinct(regexp_extract_all(concat_ws(chr(10), x[1], x[2]), {word})) as have from (select doc_id, unnest(list_zip(l, l[2:])) as x from cut)),
templates(k, label, own) as (values {values}),
hits as (select doc_id, label, len(list_intersect(have, own)) / len(own) as c from blocks, templates where len(list_intersect(have, own)) >= ceil({threshold} * len(own) - 1e-9)),
found as (select doc_id, list(distinct label) as found, max(c) as best from hits group by doc_id)
select doc_id, len(w)::bigint as n_words, ({places})::bigint as n_base, (list_min({everywhere}) - 1)::bigint as first_word, (list_max({everywhere}) - 1)::bigint as last_word,
  coalesce(array_to_string(list_sort({base}), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat({base}, coalesce(found, [])))), ','), '') as labels,
  case when {places} > 0 then 1.0 else coalesce(best, 0.0) end::double as score
from b left join found using (doc_id)"""
