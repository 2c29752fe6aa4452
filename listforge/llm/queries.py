"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listforge.llm import ann, bpe, minhash, mixing, phrases, pii, quality, sharding, suffix, urls
from listforge.llm._common import table

#: Fixed values of the URL query.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_phrases(table(spark, sf_dir, "documents")).drop("kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), size=2)


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), counted=True)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mixing, op2_substring_dedup, op3_quality_rules, op4_sharding, op5_nearest_neighbours, op6_url_filters, op7_pii_surrogates, op8_byte_bpe, op9_suffix_dedup, op10_minhash_dedup)}


#: A word, in the form that DuckDB reads.
_WORD = r"'[^\x20\x09-\x0D]+'"

_OP2_SQL = f"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) as ws from documents
), placed as (
  -- Slices of 64 words and the 12 that follow, so that no long list is copied to every word.
  select doc_id, a, ws[a + 1:a + 76] as part from (select doc_id, ws, unnest(range(0, len(ws), 64)) as a from words)
), windows as (
  select doc_id, a + k as i, part[k] as word, case when k + 12 <= len(part) then array_to_string(part[k:k + 12], ' ') end as seq
  from (select doc_id, a, part, unnest(range(1, least(64, len(part)) + 1)) as k from placed)
), firsts as (
  select seq, min(doc_id) as first_id from windows where seq is not null group by seq
), marked as (
  select doc_id, i, word, coalesce(max(case when first_id < doc_id then 1 else 0 end) over (partition by doc_id order by i rows between 12 preceding and current row), 0) as gone
  from windows left join firsts using (seq)
), sums as (
  select doc_id, sum(gone) as n, string_agg(word, ' ' order by i) filter (where gone = 0) as kept from marked group by doc_id
)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from words left join sums using (doc_id)
"""

_OP9_SQL = """
with bytes as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
), placed as (
  -- Slices of 256 bytes and the 49 that follow, so that no long text is searched for every byte.
  select doc_id, a, least(256, n - a) as m, substring(h, 2 * a + 1, 2 * 305) as part from (select doc_id, h, n, unnest(range(0, n, 256)) as a from bytes)
), windows as (
  select doc_id, a + k as i, substring(part, 2 * k - 1, 2) as byte, case when 2 * k + 98 <= length(part) then substring(part, 2 * k - 1, 100) end as seq
  from (select doc_id, a, part, unnest(range(1, m + 1)) as k from placed)
), firsts as (
  select seq, min(doc_id) as first_id from windows where seq is not null group by seq
), marked as (
  select doc_id, i, byte, coalesce(max(case when first_id < doc_id then 1 else 0 end) over (partition by doc_id order by i rows between 49 preceding and current row), 0) as gone
  from windows left join firsts using (seq)
), edges as (
  select *, gone = 1 and coalesce(lag(gone) over (partition by doc_id order by i), 0) = 0 as opens from marked
), sums as (
  select doc_id, sum(gone) as removed, count(*) filter (where opens) as spans, string_agg(byte, '' order by i) filter (where gone = 0) as kept from edges group by doc_id
)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from bytes left join sums using (doc_id)
"""

_OP10_SQL = f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) as ws from documents
), shingles as (
  select distinct doc_id, case when len(ws) > 1 then ws[i] || ' ' || ws[i + 1] else ws[1] end as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws), 2))) as i from words where len(ws) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)
), reach as (
  select doc_id, doc_id as r from words union select reach.doc_id, links.y from reach join links on links.x = reach.r
), least_ids as (
  select doc_id, min(r) as component_id from reach group by doc_id
)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from least_ids left join sizes using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": _OP2_SQL, "op9_suffix_dedup": _OP9_SQL, "op10_minhash_dedup": _OP10_SQL}
