"""The ten ``opN_<name>`` queries and the pipeline, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_extract, ngram_join, pii, quality_rules, separator_scan, suffix_dedup, token_files, toxicity
from .common import scratch_path, table

RANKS, WORD_BPE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.PATTERN
#: An id above the vocabulary ends a document in the flat files; the Parquet files' contract names its own.
FLAT_END_ID, LIST_END_ID = 50256, 1
HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_documents(docs.select("doc_id", "text"), labels, train=~F.expr(HELD_OUT))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "flat-tokens")
    separator_scan.write_flat_files(table(spark, sf_dir, "documents"), RANKS, PATTERN, path, end_id=FLAT_END_ID)
    return separator_scan.count_documents(spark, path, end_id=FLAT_END_ID)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_components(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-lists")
    token_files.write_token_files(table(spark, sf_dir, "documents"), WORD_BPE, path, end_id=LIST_END_ID)
    return token_files.token_digest(spark, path)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_toxicity, op3_byte_bpe, op4_token_counts, op5_ngram_join, op6_token_files, op7_quality_rules, op8_pii, op9_decontamination, op10_suffix_dedup)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op5_ngram_join": rf"""
with recursive
w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, list_slice(w, i, i + 4) as g from w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
reach(doc_id, r) as (select doc_id, doc_id from w union select reach.doc_id, link.b from reach join link on link.a = reach.r)
select w.doc_id, coalesce(n.n, 0) as n_shingles, (select min(r) from reach where reach.doc_id = w.doc_id) as component_id from w left join n using (doc_id)""",
    "op9_decontamination": rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item, least(10, len(w)) as m, list_slice(w, i, i + least(10, len(w)) - 1) as g from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) where len(w) > 0),
dw as (select doc_id, m, i, list_slice(w, i, i + m - 1) as g from d, (select distinct m from iw) x, unnest(range(1, len(w) - m + 2)) t(i) where len(w) >= m),
h as (select doc_id, i, m, item from dw join iw using (m, g)),
n as (select doc_id, count(distinct i + k) as n_hit from (select distinct doc_id, i, m from h) x, unnest(range(0, m)) t(k) group by doc_id),
f as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join n using (doc_id) left join f using (doc_id)""",
    "op10_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, i, hash(substr(x, 2 * i + 1, 100)) as h1, substr(x, 2 * i + 1, 24) as h2 from d, unnest(range(0, n - 49)) t(i) where n >= 50),
m as (select doc_id, i, min(doc_id) over (partition by h1, h2) as least_id from w),
r as (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from m where least_id < doc_id),
c as (select doc_id, sum(case when p is null or i - p > 50 then 50 else i - p end) as n_removed, count(*) filter (where p is null or i - p > 50) as n_spans from r group by doc_id),
k as (select doc_id, string_agg(substr(x, 2 * i + 1, 2), '' order by i) as kept from (select doc_id, x, unnest(range(0, n)) as i from d) y anti join (select distinct doc_id, i + j as i from r, unnest(range(0, 50)) t(j)) z using (doc_id, i) group by doc_id)
select d.doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join c using (doc_id) left join k using (doc_id)""",
}
