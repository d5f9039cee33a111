"""Registered queries of the subpackage: each applies one operator to its whole table, with SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomcast.llm import (byte_bpe, conversation_repair, fingerprints, lexical_search, near_dedup, packing, quality_classifier,
                          quality_rules, sharding, token_ids,
                          token_output, url_filter, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_packing")
def op1(spark, sf):
    return packing.pack(table(spark, sf, "documents"), WORD_BPE, end_id=2, length=4096)


@query("op3_bpe_round_trip")
def op3(spark, sf):
    return token_ids.round_trip(table(spark, sf, "documents"), BYTE_BPE)


@query("op2_fingerprints")
def op2(spark, sf):
    return fingerprints.searched(table(spark, sf, "documents"))


@query("op4_quality_classifier")
def op4(spark, sf):
    docs = table(spark, sf, "documents")
    return quality_classifier.score(docs, quality_classifier.learn(docs))


@query("op5_warc", """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes, sha256(payload) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from f""")
def op5(spark, sf):
    return warc.round_trip(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_TERM = r"(^|[^\p{{L}}\p{{N}}]){t}($|[^\p{{L}}\p{{N}}])"
_HITS = lambda terms: " + ".join(
    "cast(regexp_matches(lower(coalesce(url, '')), '" + _TERM.format(t=t) + "') as int)" for t in terms)


@query("op6_url_filter", f"""
with parts as (
  select page_id, url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
ruled as (
  select *,
         case when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
              when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
              when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
              when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
              when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule,
         {_HITS(url_filter.STRICT)} as strict_terms, {_HITS(url_filter.SOFT)} as soft_hits
  from parts)
select page_id, host, path, rule,
       case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
            when strict_terms > 0 or soft_hits >= 2 then 'block' else 'allow' end as verdict
from ruled""")
def op6(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op7_near_dedup")
def op7(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents"), near_dedup.Near(words=4))


@query("op8_token_output")
def op8(spark, sf):
    return token_output.written_segments(table(spark, sf, "documents"), BYTE_BPE, end_id=50256, length=2048)


# Spark's crc32 has no SQL counterpart in DuckDB, so it is left out of the SQL and tested against zlib.
@query("op9_sharding")
def op9(spark, sf):
    return sharding.byte_shards(table(spark, sf, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op10_quality_rules", r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
win as (select *, list_transform(generate_series(1, len(words) - 7), lambda i: array_to_string(words[i:i+7], ' ')) as windows from w),
pos as (select doc_id, unnest(windows) as win, unnest(generate_series(1, len(words) - 7)) as p from win),
rep as (select doc_id, p from pos qualify count(*) over (partition by doc_id, win) > 1),
cov as (select doc_id, least(8, coalesce(lead(p) over (partition by doc_id order by p) - p, 8)) as c from rep),
n_rep as (select doc_id, sum(c) as n from cov group by doc_id),
judged as (
  select *, list_filter(list_distinct(lines), lambda x: not (
      (length(regexp_replace(x, '[^#*$%&<>]', '', 'g')) * 100 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) * 40)
      or (len(regexp_extract_all(x, '[!?]{2}([\x20\x09-\x0D]|$)')) * 100 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) * 40)
      or (seps(x) >= 3 and seps(x) * 4 >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
      or len(regexp_extract_all(lower(x), 'all rights reserved|copyright|cookie|creative commons|javascript|licensed under|lorem ipsum|privacy policy|spdx-license-identifier|terms of service|terms of use')) * 15 >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))) as clean
  from w)
select cast(j.doc_id as bigint) as doc_id, cast(len(words) as bigint) as n_words,
       cast(length(array_to_string(words, '')) as bigint) as word_chars,
       cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
       cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
       cast(coalesce(n, 0) as bigint) as n_repeat_words,
       len(words) < 20 or 100 * coalesce(n, 0) > 30 * len(words) as base_failed,
       not (len(words) < 20 or 100 * coalesce(n, 0) > 30 * len(words))
         and (length(array_to_string(words, '')) - length(regexp_replace(array_to_string(clean, ' '), '[\x20\x09-\x0D]+', '', 'g'))) * 100
             <= length(array_to_string(words, '')) * 60 as kept
from judged j left join n_rep using (doc_id)""".replace("seps(x)", "(" + " + ".join(
    f"((length(x) - length(replace(x, '{p}', ''))) // 3)" for p in quality_rules.BULLETS) + ")"))
def op10(spark, sf):
    return quality_rules.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op11_byte_bpe")
def op11(spark, sf):
    return byte_bpe.round_trip(table(spark, sf, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


@query("op12_lexical_search", """
with t as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as terms
  from documents),
s as (select cast(count(*) as bigint) as docs, cast(sum(len(terms)) as bigint) as total from t where len(terms) > 0),
p as (select r, doc_id, cast(len(terms) as bigint) as n, unnest(terms) as term from t),
q as (
  select item, item_id, unnest(list_distinct(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+'))) as term
  from (select row_number() over () as item, * from benchmark)),
f as (select r, doc_id, n, term, cast(count(*) as bigint) as tf from p where term in (select term from q) group by all),
d as (select term, count(*) as df from f group by term),
c as (
  select r, doc_id, term,
         cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint)
           * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) as part
  from f join d using (term), s),
scored as (
  select item, item_id, r, doc_id, cast(sum(part) as bigint) as score from c join q using (term) group by all),
ranked as (
  select item_id, doc_id, score,
         row_number() over (partition by item order by score desc, doc_id nulls last) as rank
  from scored where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10""")
def op12(spark, sf):
    return lexical_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_conversation_repair")
def op13(spark, sf):
    return conversation_repair.repair(table(spark, sf, "conversations"))
