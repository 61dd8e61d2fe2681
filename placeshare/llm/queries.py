"""The operators over the whole of their tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeshare.llm import (
    jaccard, language, mixing, nearvectors, neighbours, packing, passages, pseudonyms, quality, secretscan, spelling, toxicity,
    whitening,
)
from placeshare.llm.common import fold_of, table

TOKENIZER = "word_bpe_49k.json"
#: stands for a secret; a real one is kept outside the code
KEY = "pseudonyms of the test corpus"


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), fold_of("doc_id", 4)
    return language.with_language(docs, language.fit(docs, fold != 2), fold == 2)


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents")).drop("other_doc")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), fold_of("doc_id", 5)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = toxicity.with_toxicity(docs, model, fold == 0)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
    )


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), fold_of("doc_id", 3)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold != 1)
    scored = quality.with_score(docs.select(F.col("doc_id").cast("long"), (fold == 1).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudonyms.pseudonymised(docs, KEY, count="n_replaced").select("doc_id", "text", "n_replaced")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_sets(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_nearvectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearvectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.frequent_words(table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, base = secretscan.secrets(table(spark, sf_dir, "documents")), ("assign", "access", "hex")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base),
        F.sha2(secretscan.listed(of(*base)), 256).alias("base_sha256"), secretscan.listed(F.col("spans")).alias("spans"),
    )


QUERIES = {f.__name__: f for f in (
    op1_language, op2_passages, op3_packing, op4_toxicity, op5_mixing, op6_neighbours, op7_quality, op8_pseudonyms,
    op9_jaccard, op10_nearvectors, op11_spelling, op12_whitening, op13_secrets,
)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_REACH = """
reach as (
  select id, id as low from nodes
  union
  select l.b, r.low from reach r join links l on l.a = r.id where l.b > r.low
)"""



def _secrets_sql() -> str:
    """All rules tried on all texts, without an index."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    each = " union all ".join(f"""
  select row, {i} as rank, {quoted(r.kind)} as kind, len(m) as k, m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) as g,
    list_transform(string_split_regex(t, {quoted(r.pattern)}), lambda x: length(x)) as gaps, {r.least} as least
  from (select *, regexp_extract_all(t, {quoted(r.pattern)}) as m from d) where len(m) > 0""" for i, r in enumerate(secretscan.RULES))
    return f"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
found as ({each}),
places as (
  select row, rank, kind, start, start + length(m[i]) as stop from (
    select *, coalesce(list_sum(gaps[1:i]), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start
    from (select *, unnest(range(1, k + 1)) as i from found)
  ) where length(g[i]) >= least
),
texts as (
  select row, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
    string_agg(concat_ws(':', kind, start::bigint, stop::bigint), ',' order by start, rank) filter (rank < 3) as base,
    string_agg(concat_ws(':', kind, start::bigint, stop::bigint), ',' order by start, rank) as spans
  from places group by row
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join texts using (row)"""


SQL = {
    "op2_passages": f"""
with d as (select doc_id, {_WORDS} as w from documents),
windows as (
  select doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)
),
hits as (select doc_id, i - 1 as s from (select *, count(*) over (partition by h) as n from windows) where n > 1),
marked as (
  select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 50 then 0 else 1 end as first from hits
),
numbered as (select doc_id, s, sum(first) over (partition by doc_id order by s) as p from marked)
select doc_id, min(s) as start_word, max(s) + 50 as end_word, max(s) + 50 - min(s) as n_words
from numbered group by doc_id, p""",
    "op9_jaccard": f"""
with recursive d as (
  select doc_id, {_WORDS.replace("coalesce(text, '')",
  "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents
),
s as (
  select distinct doc_id, unnest(case when len(w) >= 3
    then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d
),
n as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)
),
nodes as (select doc_id as id from documents),{_REACH}
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.low) as component_id
from documents d left join n on n.doc_id = d.doc_id join reach r on r.id = d.doc_id group by 1, 2""",
    "op10_nearvectors": f"""
with recursive v as (
  select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n
  from embeddings where embedding is not null
),
links as (
  select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id
  where x.n > 0 and y.n > 0 and list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.9
),
nodes as (select vec_id as id from embeddings),{_REACH},
low as (select id, min(low) as component_id from reach group by id)
select e.vec_id, (select count(*) from links where a = e.vec_id) as n_links, component_id, component_id = e.vec_id as kept
from embeddings e join low on low.id = e.vec_id""",
    "op11_spelling": f"""
with recursive codes as (
  select list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
),
found as (
  select doc_id, run, count(*) as n from (
    select coalesce(doc_id::varchar, '') as doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as run
    from documents
  ) where length(run) >= 6 group by all
),
hashed as (
  select run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''),
      lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [(192 + (unicode(c) >> 6))::bigint, (128 + (unicode(c) & 63))::bigint] end))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as h
  from found, codes
),
words as (
  select word, sum(n)::bigint as n from (
    select case when h % 199 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from hashed
  ) where length(word) >= 6 group by word having sum(n) >= 5
),
less as (select word, n, i, word[1:i - 1] || word[i + 1:] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select distinct a.word, b.word as near, b.n as near_n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union
  select a.word, w.word, w.n from less a join words w on w.word = a.rest
  union
  select w.word, a.word, a.n from less a join words w on w.word = a.rest
),
ranked as (select *, row_number() over (partition by word order by near_n desc, near) as r, count(*) over (partition by word) as c from near),
forms as (
  select w.word, w.n, coalesce(r.c, 0) as n_near, case when r.near_n >= 5 * w.n then r.near end as form,
    case when r.near_n >= 5 * w.n then r.near_n end as form_n
  from words w left join ranked r on r.word = w.word and r.r = 1
),
chain as (
  select word, word as root from forms
  union all
  select c.word, f.form from chain c join forms f on f.word = c.root where f.form is not null
)
select f.word, form, c.root, n, n_near, form_n from forms f
join (select c.* from chain c join forms f on f.word = c.root where f.form is null) c on c.word = f.word""",
    "op13_secrets": _secrets_sql(),
}
