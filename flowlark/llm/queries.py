"""Queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlark.llm import bpe, html_extract, minhash, mpeg, packing, prefix_trie, quality, resampling, secret_scan, sharding, suffix_dedup, token_counts, url_filter
from flowlark.llm.common import read


def vocabulary() -> str:
    """Path of the byte-level BPE vocabulary; FLOWLARK_VOCABULARY names another."""
    if path := os.environ.get("FLOWLARK_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary())


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), vocabulary=vocabulary())


def op9_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.media_digests(read(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(read(spark, sf_dir, "documents"), vocabulary=vocabulary())


def word_vocabulary() -> str:
    """Path of the vocabulary with word ends; FLOWLARK_WORD_VOCABULARY names another."""
    if path := os.environ.get("FLOWLARK_WORD_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), word_vocabulary())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_bpe, op2_minhash, op3_html, op4_quality, op5_suffix_dedup, op6_packing, op7_sharding, op8_url_filter, op9_mpeg, op10_secrets, op11_resampling, op12_token_counts, op13_prefix_trie)
    return {f.__name__: f for f in found}


#: All pairs by shared shingles, then the closure of the links. Word lists are the contract's.
_NEAR_SQL = r"""
with recursive d as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as materialized (
  select doc_id, unnest(case when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end) as s from d where len(w) > 0),
n as materialized (select doc_id, count(*) as n from g group by doc_id),
c as materialized (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as materialized (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
m as (select a, min(b) as b from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) as kept
from d left join n on n.doc_id = d.doc_id left join m on m.a = d.doc_id"""


#: All windows of 200 bytes, as hex; those that start more than once; the bytes they cover, and what is between.
_REPEATS_SQL = r"""
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as materialized (select doc_id, h, length(h) // 2 as n from d),
w as materialized (select doc_id, s, md5(substr(h, 2 * s + 1, 400)) as m from (select doc_id, h, unnest(range(0, n - 199)) as s from b where n >= 200)),
t as materialized (select m from w group by m having count(*) > 1),
r as materialized (select doc_id, s, lag(s) over (partition by doc_id order by s) as before, lead(s) over (partition by doc_id order by s) as after from w where m in (select m from t)),
x as (select doc_id, sum(least(200, coalesce(after - s, 200))) as gone, count(*) filter (where before is null or s - before > 200) as spans from r group by doc_id),
k as (select b.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (z - f)), '' order by f) as kept from b join (
    select doc_id, s + 200 as f, coalesce(after, 1000000000) as z from r where after is null or after - s > 200 union all select doc_id, 0, min(s) from r group by doc_id) e on e.doc_id = b.doc_id group by b.doc_id)
select b.doc_id, n as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from b left join x on x.doc_id = b.doc_id left join k on k.doc_id = b.doc_id"""


#: CRC-32 in SQL: the table of a byte's remainders, and the fold of a list of bytes.
_CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"

#: Features by their bucket, counted over corpus and target; gains, weights and draws; the highest scores.
_RESAMPLING_SQL = rf"""
with k as materialized ({_CRC_TABLE}),
w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as materialized (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
f as materialized (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from w),
bf as materialized (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from bw),
h as materialized (select f, hex(encode(f)) as h from (select f from f union select f from bf)),
b as materialized (select f, {_CRC.format(codes="list_transform(range(0, length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))")} % 10000 as b from h, k),
s as materialized (select b, count(*) as s from f join b using (f) group by b),
t as materialized (select b, count(*) as t from bf join b using (f) group by b),
n as (select (select count(*) from f) as s, (select count(*) from bf) as t),
g as materialized (select r as b, cast(floor(1000 * ln(((coalesce(t.t, 0) + 1)::double * (n.s + 10000)::double) / ((coalesce(s.s, 0) + 1)::double * (n.t + 10000)::double))) as bigint) as g
  from range(10000) x(r) left join s on s.b = r left join t on t.b = r, n),
m as materialized (select doc_id, count(*) as n, sum(g)::bigint as g from f join b using (f) join g using (b) group by doc_id),
d as materialized (select w.doc_id, len(w) as words, coalesce(n, 0) as n_features, case when n is null then 0 else cast(floor(g::double / n) as bigint) end as weight,
  cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || w.doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as draw from w left join m on m.doc_id = w.doc_id),
o as (select doc_id, row_number() over (order by weight + draw desc, doc_id) as r from d where words >= 20)
select d.doc_id, n_features, weight, weight + draw as score, case when r <= (25 * (select count(*) from o)) // 100 then r end as rank from d left join o on o.doc_id = d.doc_id"""

#: Prefixes by digests of their turns; sums over subtrees through each node's smallest member.
_TRIE_SQL = rf"""
with k as materialized ({_CRC_TABLE}),
t as materialized (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as p, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as m, length(coalesce(text, '')) as n
  from conversations where conv_id is not null),
c as materialized (select c, c - c % 100 as base, {_CRC.format(codes="list_transform(string_split(cast(c as varchar), ''), lambda x: ascii(x)::bigint)")} % 6 as h from (select distinct c from t), k),
r as materialized (select c.c, t.p as p, m, n from c join t on t.c = c.base and t.p <= c.h union all select c.c, t.p + 10, m, n from c join t on t.c = c.c and t.p > c.h),
s as materialized (select c, row_number() over w as d, md5(string_agg(m, '') over w) as key, n from r window w as (partition by c order by p)),
a as materialized (select c, d, key, n, coalesce(lag(key) over (partition by c order by d), case when d > 0 then '' end) as up, d = max(d) over (partition by c) as final
  from (select * from s union all select c, 0, '', 0 from c)),
v as materialized (select d, key, min(c) as c, count(*) as members, max(n) as n, max(up) as up, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (final), '') as ends from a group by d, key),
q as materialized (select up as key, count(*) as kids from v where d > 0 group by up),
z as materialized (select b.key, count(*) filter (q.kids is null) as leaves, sum((v.members - 1) * v.n) as saved from v left join q on q.key = v.key join a b on b.c = v.c and b.d <= v.d group by b.key)
select v.c as conv_id, v.d as depth, p.c as parent_conv_id, members as n_convs, coalesce(kids, 0) as n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, sha256(ends) as ends_sha256
from v join z on z.key = v.key left join q on q.key = v.key left join (select key, c from v) p on p.key = v.up and v.d > 0"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": _NEAR_SQL, "op5_suffix_dedup": _REPEATS_SQL, "op11_resampling": _RESAMPLING_SQL, "op13_prefix_trie": _TRIE_SQL}
