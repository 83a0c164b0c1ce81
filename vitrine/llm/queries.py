"""The registered queries of the training-data operators, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import bpe, brown, collocations, decontam, langid, minhash, pii, quality, suffixes, templates, toolcalls, topk, variants
from vitrine.llm.common import remainder, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = langid.profiles(docs.filter(remainder("doc_id", 3) != 1))
    return docs.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        langid.identify(docs, known).alias("found"),
    ).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.matches(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = brown.scores(docs, remainder("doc_id", 7) != 2)
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, *scored.columns[1:])


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judged(docs, quality.references(docs)).drop("text", "lang")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.linked(*toolcalls.from_turns(table(spark, sf_dir, "conversations")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN).drop("text")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(embeddings, F.col("vec_id") % 100 == 0, k=10)


REGISTERED = (
    op1_language_id, op2_decontamination, op3_near_duplicates, op4_html, op5_brown_scores, op6_repeated_strings,
    op7_quality, op8_pii, op9_tool_calls, op10_bpe, op11_collocations, op12_spelling_variants, op13_topk,
)
QUERIES = {f.__name__: f for f in REGISTERED}

ORACLES: dict[str, str] = {
    "op11_collocations": """
with p as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) p
  from documents
), w as (select lang, regexp_extract_all(p, '[^ \\t]+') w from p),
g as (
  select lang, 1 k, unnest(w) phrase from w
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w
), f as materialized (select lang, k, phrase, cast(count(*) as hugeint) a, string_split(phrase, ' ') w from g group by lang, k, phrase),
n as (select lang, sum(a) n from f where k = 1 group by lang),
c as (select * from f where k > 1 and a >= 10),
cuts as (
  select lang, phrase, k, a, w, unnest(range(1, k)) i from c
), cut_ as (
  select *, array_to_string(w[:i], ' ') lp, array_to_string(w[i + 1:], ' ') rp from cuts
), sided as (
  select t.lang, t.phrase, t.k, t.a, t.i, x.a l, y.a r, 1000000 * t.a * t.a // (x.a * y.a) score
  from cut_ t join f x on x.lang = t.lang and x.phrase = t.lp join f y on y.lang = t.lang and y.phrase = t.rp
), s as (select * from sided qualify row_number() over (partition by lang, phrase order by score, i) = 1),
longer as (
  select lang, array_to_string(w[:2], ' ') phrase, a from c where k = 3
  union all select lang, array_to_string(w[2:], ' '), a from c where k = 3
), most as (select lang, phrase, max(a) most from longer group by all),
o as (
  select s.*, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) "rank"
  from s left join most m on m.lang = s.lang and m.phrase = s.phrase and s.k = 2
  where m.most is null or 100 * m.most < 50 * s.a
)
select o.lang, cast("rank" as bigint) "rank", phrase, cast(a as bigint) a, cast(l as bigint) l, cast(r as bigint) r,
  cast(n as bigint) n, cast(score as bigint) score
from o join n on n.lang = o.lang where "rank" <= 2000""",
    "op12_spelling_variants": """
with recursive step as (
  select i, cast(i as bigint) c, 0 k from range(256) r(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8
), crc as (select list(c order by i) t from step where k = 8),
run as (
  select doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) r
  from documents
), named as (select r, encode(coalesce(cast(doc_id as varchar), '') || ':' || r) x, count(*) m from run where length(r) >= 5 group by all),
hashed as (
  select r, m, xor(list_reduce(
    list_prepend(cast(4294967295 as bigint),
      list_transform(range(0, octet_length(x)), lambda i: cast('0x' || substr(hex(x), 2 * i + 1, 2) as bigint))),
    lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) h from named, crc
), made as (
  select m, case when h % 97 = 0 then substr(r, 1, cast(h % length(r) as int)) || substr(r, cast(h % length(r) as int) + 2) else r end word
  from hashed
), words as (select word, cast(sum(m) as bigint) n from made where length(word) >= 5 group by word having sum(m) >= 3),
less as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) rest from (select *, unnest(range(1, length(word) + 1)) i from words)),
near as (
  select a.word, b.word other, b.n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word
), best as (
  select word, other, n, count(*) over (partition by word) n_near from near
  qualify row_number() over (partition by word order by n desc, other) = 1
), formed as (
  select w.word, w.n, coalesce(n_near, 0) n_near, case when b.n >= 2 * w.n then other end form, case when b.n >= 2 * w.n then b.n end form_n
  from words w left join best b using (word)
), walk as (
  select word, form last, 1 k from formed where form is not null
  union all
  select walk.word, formed.form, k + 1 from walk join formed on formed.word = walk.last where formed.form is not null
), ends as (select word, arg_max(last, k) root from walk group by word)
select word, form, coalesce(root, word) root, n, n_near, form_n from formed left join ends using (word)""",
    "op13_topk": """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id query_id, c.vec_id,
    coalesce(list_sum(list_transform(range(1, 1 + least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])), 0) score
  from v q join v c on c.vec_id <> q.vec_id
  where q.vec_id % 100 = 0
), r as (
  select query_id, vec_id, cast(score as bigint) score,
    cast(row_number() over (partition by query_id order by score desc, vec_id) as int) "rank"
  from s
)
select query_id, "rank", vec_id, score from r where "rank" <= 10""",
}
