"""The registered queries of this package: each dealt operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrapanel.llm import decontamination, embeddings, language, minhash, pieces, quality, runs, sharding, suffixes, toxicity, tries, urlrules, wrappers
from terrapanel.llm.common import read

# The rules of the URL query, as (verdict, host and path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.report(read(spark, sf_dir, "pages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(read(spark, sf_dir, "pages"), urlrules.rule_table(spark, URL_RULES))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(read(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.report(read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = [
    op1_html_extraction, op2_sentencepiece, op3_toxicity, op4_decontamination, op5_url_filters,
    op6_embedding_dedup, op7_minhash_dedup, op8_language_id, op9_sharding, op10_quality, op11_periodic_runs, op12_suffix_dedup, op13_prefix_trie,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in [*OPERATORS, pipeline]}

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# Positions of a window: every document word that starts one, found by joining window texts.
DECONTAMINATION_SQL = f"""
with items as (select item_id, {_WORDS.format('text')} as w from benchmark where text is not null),
windows as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from items where len(w) > 0)),
docs as (select doc_id, coalesce({_WORDS.format('text')}, []) as w from documents),
places as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from docs cross join (select distinct n from windows) where len(w) >= n)),
hits as (select p.doc_id, p.i, p.n, x.item_id from places p join windows x on p.win = x.win and p.n = x.n),
covered as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as pos from hits) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join covered c on c.doc_id = d.doc_id left join named m on m.doc_id = d.doc_id"""

URL_SQL = f"""
with rules(verdict, rule) as (values {', '.join(f"('{v}', '{r}')" for v, r in URL_RULES)}),
cut as (select *, split_part(rule, '/', 1) as h, substr(rule, instr(rule, '/')) as p from rules),
rests as (select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests),
fits as (select t.page_id, t.host, t.path, c.rule, c.verdict, row_number() over (partition by t.page_id order by length(c.rule) desc) as rk
  from parts t left join cut c on (t.host = c.h or ends_with(t.host, '.' || c.h)) and starts_with(t.path, c.p))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where rk = 1"""

EMBEDDING_SQL = """
with recursive usable as (select vec_id, label, cast(embedding as double[]) as v from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id
  and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
own as (select vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links, least(vec_id, coalesce((select min(b) from reach r where r.a = e.vec_id), vec_id)) as component_id from embeddings e)
select vec_id, cast(n_links as bigint) as n_links, component_id, vec_id = component_id as kept from own"""

MINHASH_SQL = f"""
with recursive docs as (select doc_id, {_WORDS.format('text')} as w from documents where text is not null),
shingles as (select distinct doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') as s from
  (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as c from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b where c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
least_of as (select a, min(b) as m from reach group by 1)
select d.doc_id, least(d.doc_id, coalesce(m, d.doc_id)) as class_id, d.doc_id <= coalesce(m, d.doc_id) as kept
from documents d left join least_of l on l.a = d.doc_id"""

# crc32 of the decimal id, byte by byte and bit by bit (-1 stands for a shift); a conversation is the list of its turns.
TRIE_SQL = """
with recursive own as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as k,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} as x from conversations where conv_id is not null),
sizes as (select c, count(*) as n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(cast(c as varchar), ''), lambda d: [cast(ascii(d) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end) end), 4294967295) % 9 as h from own group by c),
turns as (select o.c, k + 100 as k, x from own o join sizes s on o.c = s.c where k > h
  union all select s.c, k, x from sizes s join own o on o.c = s.c - s.c % 5 where k <= h),
convs as (select s.c, coalesce(list(t.x order by t.k) filter (t.x is not null), []) as l from sizes s left join turns t on t.c = s.c group by s.c),
paths as (select c, l, d, len(l) as n, l[1:d] as p from (select c, l, unnest(generate_series(0, len(l))) as d from convs)),
nodes as (select p, d, min(c) as o, count(*) as n_convs, max(n) as longest, case when d = 0 then 0 else strlen(p[d].t) end as b,
  sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (n = d), '')) as ends from paths group by p, d),
named as (select t.c, t.d, o, n_convs, longest, b from paths t join nodes v on t.p = v.p and t.d = v.d),
parents as (select distinct v.o, v.d, u.o as parent from named v join named u on u.c = v.c and u.d = v.d - 1),
below as (select distinct u.o, u.d, v.o as vo, v.d as vd, v.n_convs, v.b, v.longest from named u join named v on v.c = u.c and v.d >= u.d),
sums as (select o, d, count(*) filter (longest = vd) as n_leaves, count(*) filter (vd = d + 1) as n_children, sum((n_convs - 1) * b) as saved from below group by o, d)
select v.o as conv_id, cast(v.d as bigint) as depth, parent as parent_conv_id, v.n_convs, n_children, n_leaves, cast(saved as bigint) as saved_tokens, ends as ends_sha256
from nodes v join sums s on s.o = v.o and s.d = v.d left join parents q on q.o = v.o and q.d = v.d"""

SQL: dict[str, str] = {
    "op4_decontamination": DECONTAMINATION_SQL,
    "op5_url_filters": URL_SQL,
    "op6_embedding_dedup": EMBEDDING_SQL,
    "op7_minhash_dedup": MINHASH_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
