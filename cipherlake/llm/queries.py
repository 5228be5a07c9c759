"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.llm import chat, collocations, decontaminate, language, line_dedup, near_dup, negatives, packing, pii, quality, substring_dedup, topk, vector_dups


#: The registered query's key; real runs bring their own.
PII_KEY = b"cipherlake"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(parts: int, which: int) -> Column:
    """Whether crc32 of the document's number as text leaves ``which`` over ``parts``."""
    return F.crc32(F.col("doc_id").cast("string")) % parts == which


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(4, 2))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"), remainder(3, 1))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.checked_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.labelled_vectors(table(spark, sf_dir, "embeddings"), label)
    return negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


def op13_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.linked(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk, op2_quality, op3_packing, op4_substring_dedup, op5_line_dedup, op6_language, op7_near_dup, op8_decontaminate, op9_chat, op10_pii, op11_collocations, op12_hard_negatives, op13_embedding_dups)}


OP1_SQL = """
with e as (
  select vec_id, min(list_transform(embedding, lambda x: cast(x as double))) as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id),
v as (select vec_id, list_transform(x, lambda y: floor(64 * y)) as v from e),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""


OP11_SQL = r"""
with recursive texts as (
  select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
pieces as (select d, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece, generate_subscripts(string_split_regex(text, '[.,;:!?\x0A-\x0D]'), 1) as p from texts),
split as (select d, lang, p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as words from pieces),
words as (select d, lang, p, unnest(words) as w, generate_subscripts(words, 1) as i from split),
runs as (
  select lang, w as w1, lead(w, 1) over o as w2, lead(w, 2) over o as w3, lead(w, 3) over o as w4
  from words window o as (partition by d, p order by i)),
totals as (select lang, count(*) as n from words group by lang),
f as (
  select lang, [w1] as ws, count(*) as f from runs group by lang, w1
  union all select lang, [w1, w2], count(*) from runs where w2 is not null group by lang, w1, w2
  union all select lang, [w1, w2, w3], count(*) from runs where w3 is not null group by lang, w1, w2, w3
  union all select lang, [w1, w2, w3, w4], count(*) from runs where w4 is not null group by lang, w1, w2, w3, w4),
c as (select lang, ws, f as a from f where f >= 30 and len(ws) > 1),
cuts as (
  select c.lang, c.ws, c.a, k, x.f as l, y.f as r, cast(2000000 as hugeint) * c.a // (x.f + y.f) as score
  from c, range(1, 4) as ks(k), f as x, f as y
  where k < len(c.ws) and x.lang = c.lang and x.ws = c.ws[1:k] and y.lang = c.lang and y.ws = c.ws[k + 1:]),
scored as (select * from cuts qualify row_number() over (partition by lang, ws order by score, k) = 1),
inner_phrases as (
  select c.lang, c.ws[s:s + m - 1] as ws, max(c.a) as f
  from c, range(2, 4) as ms(m), range(1, 4) as ss(s) where m < len(c.ws) and s + m - 1 <= len(c.ws) group by all),
ranked as (
  select s.lang, array_to_string(s.ws, ' ') as phrase, s.a, s.l, s.r, s.score
  from scored s left join inner_phrases i on i.lang = s.lang and i.ws = s.ws
  where not coalesce(cast(100 as hugeint) * i.f >= cast(80 as hugeint) * s.a, false)),
best as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from ranked)
select b.lang, cast(b.rank as bigint) as rank, b.phrase, cast(b.a as bigint) as a, cast(b.l as bigint) as l, cast(b.r as bigint) as r,
  cast(t.n as bigint) as n, cast(b.score as bigint) as score
from best b join totals t on t.lang = b.lang where b.rank <= 2000
"""


OP12_SQL = """
with e as (
  select vec_id, min({'label': cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint), 'x': list_transform(embedding, lambda x: cast(x as double))}) as r
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id),
v as (select vec_id, r.label as label, list_transform(r.x, lambda y: floor(256 * y)) as v from e),
s as (
  select q.vec_id as anchor_id, c.vec_id as vec_id, q.label = c.label as same, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""


OP13_SQL = """
with recursive e as (
  select vec_id, min(case when len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 then list_transform(embedding, lambda x: cast(x as double)) end) as x
  from embeddings group by vec_id),
v as (select vec_id, x from e where vec_id is not null and x is not null and list_inner_product(x, x) > 0),
links as (select a.vec_id as src, b.vec_id as dst from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.x, b.x) >= 0.95),
reach as (select src, dst from links union select r.src, l.dst from reach r join links l on l.src = r.dst),
n as (select src, count(*) as n from links group by src),
least as (select src, min(dst) as m from reach group by src)
select e.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, coalesce(least.m, e.vec_id) as component_id,
  coalesce(e.vec_id = coalesce(least.m, e.vec_id), true) as kept
from e left join n on n.src = e.vec_id left join least on least.src = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op11_collocations": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_embedding_dups": OP13_SQL}
