"""The queries of this subpackage: ``opN_<name>`` over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog.llm import ann, decontaminate, html_extract, language_id, license_scan, lm_scoring, near_dedup, packing, suffix_dedup, url_filter
from evlog.llm.sparkio import table


def tokenizer_path() -> str:
    """The public byte-level BPE file, found on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("n_blocks")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), held_out, cutoff=1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    learned = language_id.samples(docs, ~held_out)
    return language_id.identify(docs.select("doc_id", "text"), learned).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match", "matches")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=(85, 100))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_language_id": op5_language_id,
    "op6_ann": op6_ann,
    "op7_decontamination": op7_decontamination,
    "op8_packing": op8_packing,
    "op9_near_dedup": op9_near_dedup,
    "op10_url_filter": op10_url_filter,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TOKENS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": license_scan.oracle_sql(),
    "op7_decontamination": f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select item_id::varchar as item, {_WORDS} as w from benchmark),
iw as (select distinct item, n, array_to_string(w[k:k + n - 1], ' ') as win from (select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as k from i where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)),
h as (select doc_id, n, k, item from dw join iw using (n, win)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from h) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from h) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join found using (doc_id)""",
    "op9_near_dedup": f"""
with recursive d as (select doc_id, {_TOKENS} as w from documents),
s as (select distinct doc_id, array_to_string(w[k:k + 2], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as k from d where len(w) > 0)),
c as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from p join c cx on x = cx.doc_id join c cy on y = cy.doc_id where 100 * k >= 85 * (cx.n + cy.n - k)),
e as (select x, y from l union all select y, x from l),
r(doc_id, m) as (select doc_id, doc_id from d union select e.y, r.m from r join e on r.doc_id = e.x)
select r.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(m) as component_id, r.doc_id = min(m) as kept from r left join c using (doc_id) group by r.doc_id""",
}
