"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinframe.llm import audit, near, packing, phrases, pieces, pivots, positive, private, quality, suffixes, tokens, urls, variants
from basinframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_packing")
def _(spark, folder):
    path = public_tokenizers.path
    return packing.pack(table(spark, folder, "documents"), path("byte_bpe_50k.json"), ranks=path("byte_bpe_50k.tiktoken"))


@query("op5_sentencepiece")
def _(spark, folder):
    return pieces.encode_digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_superminhash")
def _(spark, folder):
    return near.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


@query("op7_token_counts")
def _(spark, folder):
    return tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_phrase_dedup")
def _(spark, folder):
    return phrases.phrase_digests(table(spark, folder, "documents"))


@query("op3_topk")
def _(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return pivots.top_k(vectors, F.col("vec_id") % 50 == 0)


@query("op4_private")
def _(spark, folder):
    found = private.find_private(table(spark, folder, "documents"))
    counts = [f"n_{k}" for k in private.ORDER]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op8_quality")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.quality_rules(docs, quality.train_line_model(docs, table(spark, folder, "labels")))


_OP9 = """
with pages_at as (
  select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) as host,
    date '2024-01-01' + cast(page_id * 37 % 365 as integer) as fetched_on from pages),
hosts as (select distinct host from pages_at where host <> ''),
named as (
  select 'host' as kind, host as value from hosts where length(host) % 3 = 0
  union all select distinct 'domain', regexp_extract(host, '([^.]+[.][^.]+)$', 1) from hosts where length(host) % 5 = 0),
entries as (
  select kind, value, date '2024-01-01' + cast((length(value) * 29 + ascii(value) * 7) % 200 + step * 50 as integer) as listed_on,
    case when step = 1 then 'remove' else 'add' end as action
  from named, (select unnest([0, 1, 2]) as step) steps),
spans as (
  select kind, value, action, listed_on as since,
    lead(listed_on) over (partition by kind, value order by listed_on, action) as until from entries),
hits as (
  select p.page_id, s.kind || ':' || s.value as rule from pages_at p join spans s
  on s.action = 'add' and s.since <= p.fetched_on and (s.until is null or p.fetched_on < s.until)
  and (s.kind = 'host' and p.host = s.value
    or s.kind = 'domain' and (p.host = s.value or ends_with(p.host, '.' || s.value))))
select p.page_id, p.host, strftime(p.fetched_on, '%Y-%m-%d') as fetched_on, count(h.rule) as n_active, min(h.rule) as rule,
  count(h.rule) > 0 as blocked
from pages_at p left join hits h using (page_id) group by all
"""


@query("op9_url_filters", _OP9)
def _(spark, folder):
    """A list drawn from the hosts: listed, taken off and listed again at dates of their own."""
    start = F.to_date(F.lit("2024-01-01"))
    pages = table(spark, folder, "pages").select(
        "page_id", "url", F.date_add(start, (F.col("page_id") * 37 % 365).cast("int")).alias("fetched_on")
    )
    hosts = pages.select(urls.host_of("url").alias("host")).where("host is not null").distinct()
    two = F.regexp_extract("host", r"([^.]+[.][^.]+)$", 1)
    named = hosts.where("length(host) % 3 = 0").select(F.lit("host").alias("kind"), F.col("host").alias("value"))
    named = named.union(hosts.where("length(host) % 5 = 0").select(F.lit("domain"), two).distinct())
    day = (F.length("value") * 29 + F.ascii("value") * 7) % 200 + F.col("step") * 50
    entries = named.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "kind",
        "value",
        F.date_add(start, day.cast("int")).alias("listed_on"),
        F.when(F.col("step") == 1, "remove").otherwise("add").alias("action"),
    )
    found = urls.filter_urls(pages, entries)
    return found.select("page_id", "host", F.date_format("fetched_on", "yyyy-MM-dd").alias("fetched_on"), "n_active", "rule", "blocked")


@query("op10_suffix_dedup")
def _(spark, folder):
    return suffixes.repeat_digests(table(spark, folder, "documents"))


_OP13 = """
with words as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
marks as (
  select doc_id, max(cast(quality = 1 as integer)) as good, max(cast(toxic = 1 as integer)) as toxic from labels group by 1),
masks as (
  select part, doc_id,
    cast(len(w) < 100 as integer) + 2 * cast(100 * len(list_distinct(w)) < 80 * len(w) as integer)
    + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) as integer)
    + 8 * cast(regexp_matches(t, '[#$%&*|]') as integer)
    + 16 * cast(coalesce(doc_id > min(doc_id) over (partition by t), false) as integer) as mask from words),
cells as (
  select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
  from masks left join marks using (doc_id) group by all),
filters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from filters a, filters b, filters c, filters d, filters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (
  select filter_order, s as step, bits[s] as bit, cast(coalesce(list_sum(bits[1:s - 1]), 0) as integer) as before
  from orders, (select unnest([1, 2, 3, 4, 5]) as s)),
counts as (
  select part, filter_order, step, bit,
    sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
    sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end) as removed,
    sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end) as good_lost,
    sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end) as toxic_lost
  from cells, steps group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley from counts
"""


@query("op13_filter_audit", _OP13)
def _(spark, folder):
    return audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_spelling_variants")
def _(spark, folder):
    return variants.spelling_variants(table(spark, folder, "documents"))


@query("op11_quality_score")
def _(spark, folder):
    return positive.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
