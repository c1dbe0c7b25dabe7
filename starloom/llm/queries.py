"""The queries ``opN_<name>`` with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import bm25, chat_format, exact_dedup, language_id, minhash, packing, piece_codec, substring_dedup, token_codes, url_filter
from starloom.session import read_table, scratch_path

URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), url_filter.UrlPolicy(rules=URL_RULES))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.collapse_and_render(read_table(spark, sf_dir, "conversations"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), window=35, digest=True)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_copies(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    queries = docs.filter(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return bm25.search(docs, queries, k=10)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op8_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-codes")
    token_codes.write(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_codes.read(spark, path)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _url_sql() -> str:
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in URL_RULES.items())

    def free(term: str) -> str:
        return f"regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){term}([^\\p{{L}}\\p{{N}}]|$)')::int"

    strict = " + ".join(map(free, url_filter.STRICT_TERMS))
    soft = " + ".join(f"{w} * {free(t)}" for t, w in url_filter.SOFT_TERMS.items())
    count = " + ".join(map(free, url_filter.SOFT_TERMS))
    policy = url_filter.UrlPolicy()
    return f"""
with rules(rule, rhost, rpath, said) as (values {rules}),
cut as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as u
  from pages),
parts as (
  select page_id, url, u,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut),
hits as (select *, {strict} as strict_hits, {soft} as soft_weight, {count} as soft_hits from parts),
ruled as (
  select h.*, (select max_by(r.rule, length(r.rule)) from rules r
               where (h.host = r.rhost or ends_with(h.host, '.' || r.rhost)) and starts_with(h.path, r.rpath)) as rule
  from hits h)
select page_id, host, path, ruled.rule,
       coalesce(rules.said, case when strict_hits > 0 or (soft_hits >= {policy.soft_terms} and soft_weight >= {policy.soft_limit}) then 'block' else 'allow' end) as verdict,
       strict_hits::int as strict_hits, soft_weight::int as soft_weight
from ruled left join rules on rules.rule = ruled.rule"""


_CHAT_SQL = f"""
with ordered as (
  select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as n
  from conversations),
marks as (
  select conv_id, n, list({{'r': role, 't': text}}) over (partition by conv_id order by n) as turns from ordered),
whole as (select conv_id, max(n) as n, max_by(turns, n) as turns from marks group by conv_id),
prefixes as (
  select distinct m.n, m.turns from marks m join whole w on m.conv_id is not distinct from w.conv_id and m.n < w.n),
said as (
  select w.conv_id, w.n, w.turns, p.n is not null as snapshot,
         row_number() over (partition by w.n, w.turns order by w.conv_id nulls first) = 1 as first_one
  from whole w left join prefixes p on p.n = w.n and p.turns = w.turns),
texts as (
  select conv_id, string_agg('{chat_format.TURN_OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{chat_format.TURN_CLOSE}' || chr(10), '' order by n) as rendered
  from ordered group by conv_id)
select s.conv_id, s.n as n_turns, not s.snapshot and s.first_one as kept,
       case when s.snapshot then 'snapshot' when s.first_one then 'maximal' else 'repeat' end as reason,
       case when not s.snapshot and s.first_one then t.rendered end as rendered
from said s join texts t on s.conv_id is not distinct from t.conv_id"""

_BM25_SQL = f"""
with bag as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) as term
  from documents),
tf as (select doc_id, term, count(*) as tf from bag group by all),
dl as (select d.doc_id, coalesce(s.n, 0) as dl from documents d left join (select doc_id, sum(tf) as n from tf group by 1) s using (doc_id)),
whole as (select count(*) as n, avg(dl) as mean_dl from dl),
df as (select term, count(*) as df from tf group by term),
hits as (
  select q.doc_id as query_id, t.doc_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * t.tf * {bm25.K1 + 1} / (t.tf + {bm25.K1} * (1 - {bm25.B} + {bm25.B} * dl / mean_dl))), 6) as score
  from tf q join df using (term) join tf t using (term) join dl on dl.doc_id = t.doc_id, whole
  where q.doc_id % 20 = 0 group by all)
select query_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, doc_id, score
from hits qualify rank <= 10"""

_EXACT_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id is not distinct from max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d"""

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

_SUBSTRING_SQL = f"""
with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as words from documents),
starts as (select doc_id, words, unnest(range(1, len(words) - 33)) as i from w where len(words) >= 35),
windows as (select doc_id, i, array_to_string(words[i:i + 34], ' ') as said from starts),
repeated as (select said from windows group by said having count(*) > 1),
gone as (select doc_id, i from windows semi join repeated using (said)),
lost as (select distinct doc_id, unnest(range(i, i + 35)) as place from gone),
each as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from w),
kept as (select doc_id, string_agg(word, ' ' order by place) as said, count(*) as n from each anti join lost using (doc_id, place) group by doc_id)
select w.doc_id, len(words) as n_words, len(words) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.said, '')) as kept_sha256
from w left join kept using (doc_id)"""

_NEAR_SQL = f"""
with recursive w as (
  select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as words from documents),
pairs as (select doc_id, words, unnest(range(1, greatest(len(words), 2))) as i from w where len(words) > 0),
sets as (select distinct doc_id, array_to_string(words[i:i + 1], ' ') as said from pairs),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from sets a join sets b on a.said = b.said and a.doc_id <> b.doc_id join sizes m on m.doc_id = a.doc_id join sizes n on n.doc_id = b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (any_value(m.n) + any_value(n.n) - count(*))),
reach as (select a as doc_id, a as far from links union select reach.doc_id, links.b from reach join links on links.a = reach.far),
least as (select doc_id, min(far) as component_id from reach group by doc_id)
select w.doc_id, coalesce(sizes.n, 0) as n_shingles, coalesce(least.component_id, w.doc_id) as component_id, coalesce(least.component_id, w.doc_id) = w.doc_id as kept
from w left join sizes using (doc_id) left join least using (doc_id)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_chat_format": op2_chat_format,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bm25_search": op5_bm25_search,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op8_token_codes": op8_token_codes,
    "op9_minhash": op9_minhash,
    "op10_piece_codec": op10_piece_codec,
}

SQL: dict[str, str] = {"op1_url_filter": _url_sql(), "op2_chat_format": _CHAT_SQL, "op3_substring_dedup": _SUBSTRING_SQL, "op4_exact_dedup": _EXACT_SQL, "op5_bm25_search": _BM25_SQL, "op9_minhash": _NEAR_SQL}
