"""Queries of the training-data operators over whole tables, and SQL that computes the same with other means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bpe import encode_corpus
from cairn.llm.distinctive import document_scores, dominant_terms, rarity_weighted
from cairn.llm.leaks import find_leaks
from cairn.llm.leximin import leximin_ranking, leximin_vectors, strong_everywhere
from cairn.llm.markup import clean_markup
from cairn.llm.neardup import document_pairs, near_duplicate_groups, near_duplicates
from cairn.llm.reading import calibrated, demanding, reading_level
from cairn.llm.split import split_pieces
from cairn.llm.vptree import nearest_vectors, similar_pairs
from cairn.tables import table


#: The vocabulary file of the public tokenizer byte_bpe_50k.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(nearest_vectors(table(spark, sf_dir, "content_vectors"), k=5, least_cos=0.9))


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "content_vectors"), k=5)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant_terms(document_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content")), "doc_id", rarity_weighted(), 1.37)


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = document_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content"))
    return scores.select("doc_id", "term", "n", "d", F.round("expected", 6).alias("expected"), F.round("residual", 4).alias("residual"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = near_duplicates(table(spark, sf_dir, "content"), "hash", "doc", shingle=3, threshold=0.7, least_words=50)
    return document_pairs(table(spark, sf_dir, "documents"), members, links)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "content"), "hash", "doc", shingle=3, threshold=0.7, least_words=50)
    named = groups.groupBy("component").agg(F.min("hash").alias("first"), F.count(F.lit(1)).alias("size"))
    return groups.join(named, "component").select("hash", "first", "size")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_clean(spark, sf_dir).select("hash", F.explode("kinds").alias("kind"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_markup(table(spark, sf_dir, "content"), keep=["hash"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strong_everywhere(leximin_vectors(table(spark, sf_dir, "ranked"))).select("query_id", "filepath")


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = leximin_ranking(table(spark, sf_dir, "ranked"))
    return ranked.select("query_id", "filepath", "n_lists", "present", F.round(F.col("weakest_first")[0], 6).alias("weakest"), "position")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = table(spark, sf_dir, "content").select("hash", "doc")
    return split_pieces(content, only_long=True).select("hash", "seq", "pos")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), TOKENIZER, keep=["doc_id"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).where("verbatim > 0").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demanding(reading_level(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = reading_level(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return levels.select("doc_id", "n_words", "n_sentences", F.round("unfamiliar", 6).alias("unfamiliar"), F.round("score", 6).alias("score"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = reading_level(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return calibrated(levels, table(spark, sf_dir, "reading_labels")).select("doc_id", "n_words", "n_sentences", F.round("unfamiliar", 6).alias("unfamiliar"), F.round("score", 6).alias("score"), "level")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_nearest, p3_found, p3_scores, p4_found, p4_groups, p5_found, p5_clean, p6_found, p6_ranking, p7_found, p8_ids, p9_found, p9_leaks, p10_found, p10_scores, p10_levels)}


_TERMS = r"""
with records as (select doc_id, concat_ws(chr(10), title, doc) as t from documents join content using (hash) where title is not null),
words as (select doc_id, lower(unnest(regexp_extract_all(t, '[\p{L}\p{N}]+'))) as term from records),
counts as (select doc_id, term, count(*) as n from words group by all),
lens as (select doc_id, sum(n) as len from counts group by all),
terms as (select term, count(*) as d, sum(n) as c from counts group by all),
al as (select (select count(*) from records) as n_all, (select sum(n) from counts) as total)
"""
P3_FOUND = _TERMS + """
, scored as (select doc_id, term, n * ln(n_all / d) as s from counts join terms using (term), al),
two as (select *, row_number() over (partition by doc_id order by s desc, term) as r, lead(s) over (partition by doc_id order by s desc, term) as s2 from scored)
select doc_id, term from two where r = 1 and s > 0 and s2 is not null and s >= 1.37 * s2
"""
P3_SCORES = _TERMS + """
, e as (select doc_id, term, n, d, c, len, total, len * c / total::double as expected from counts join terms using (term) join lens using (doc_id), al)
select doc_id, term, n, d, round(expected, 6) as expected,
       round(case when (1 - len / total::double) * (1 - c / total::double) > 0
             then (n - expected) / sqrt(expected) / sqrt((1 - len / total::double) * (1 - c / total::double)) end, 4) as residual
from e
"""

P1_FOUND = r"""
with n as (select vid, list_transform(embedding, lambda x: coalesce(x, 'nan'::float)) as e from content_vectors where vid is not null and len(embedding) = 64),
v as (select vid, min(e) as e from n where not isnan(list_sum(e)) and list_dot_product(e, e) > 0 group by vid),
p as (select x.vid as a, y.vid as b, list_cosine_similarity(x.e::double[], y.e::double[]) as c from v x join v y on x.vid <> y.vid),
r as (select *, row_number() over (partition by a order by c desc, b) as r from p)
select distinct least(a, b) as vid_a, greatest(a, b) as vid_b from r where r <= 5 and c >= 0.9
"""

_LINKS = r"""
with recursive w as (select hash, list_transform(regexp_extract_all(doc, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from content),
s as (select distinct hash, array_to_string(w[i : i + 2], ' ') as g from (select hash, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 50)),
sizes as (select hash, count(*) as n from s group by hash),
meet as (select x.hash as a, y.hash as b, count(*) as m from s x join s y on x.g = y.g and x.hash < y.hash group by all),
links as (select a, b from meet join sizes p on p.hash = a join sizes q on q.hash = b where m >= 0.7 * (p.n + q.n - m)
          union all select hash, hash from sizes)
"""
P4_FOUND = _LINKS + """
select distinct least(x.doc_id, y.doc_id) as doc_a, greatest(x.doc_id, y.doc_id) as doc_b
from links join documents x on x.hash = a join documents y on y.hash = b where x.doc_id <> y.doc_id
"""

P4_GROUPS = _LINKS + """
, sides as (select a, b from links union all select b, a from links),
reached as (select a, b from sides union select r.a, l.b from reached r join sides l on r.b = l.a)
select a as hash, min(b) as first, count(distinct b) as size from reached group by a
"""

_LISTS = """
with best as (
  select query_id, list_id, filepath, max(backend_score) as score from ranked
  where backend_score is not null and not isnan(backend_score) and filepath is not null group by all),
placed as (
  select *, row_number() over (partition by query_id, list_id order by score desc, filepath) as r,
         count(*) over (partition by query_id, list_id) as size from best),
lists as (select query_id, count(distinct list_id) as n_lists from best group by query_id),
items as (
  select query_id, filepath, list_sort(list((size - r + 1) / size)) as v, count(*) as present, max(r) as worst
  from placed group by all)
"""
P6_FOUND = _LISTS + """
select query_id, filepath from items join lists using (query_id) where n_lists >= 2 and present = n_lists and worst <= 3
"""
P6_RANKING = _LISTS + """
, whole as (
  select query_id, filepath, n_lists, present, list_concat(list_transform(range(n_lists - present), lambda x: 0.0::double), v) as v
  from items join lists using (query_id))
select query_id, filepath, n_lists, present, round(v[1], 6) as weakest,
       row_number() over (partition by query_id order by v desc, filepath) as position
from whole
"""

P9_FOUND = r"""
with d as (select doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from documents),
i as (select item_id, list_transform(regexp_extract_all(passage, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from eval_items),
dw as (select doc_id, array_to_string(w[s : s + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as s from d where len(w) >= 13)),
iw as (select distinct item_id, array_to_string(w[s : s + 12], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as s from i where len(w) >= 13))
select distinct doc_id, item_id from dw join iw using (g)
"""

P10_FOUND = r"""
with m as (
  select doc_id, coalesce(len(regexp_extract_all(text, '\p{L}+')), 0) as words,
         coalesce(length(regexp_replace(text, '\P{L}+', '', 'g')), 0) as letters,
         greatest(coalesce(len(regexp_extract_all(text, '[.!?]+(?:[ \t\r\n]|\z)')), 0), 1) as ends
  from documents)
select doc_id from m where words >= 60 and words >= 20 * ends and letters >= 6 * words
"""
P10_SCORES = r"""
with each as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) as word from documents),
familiar as (select word from each group by word having count(*) >= 0.01 * (select count(*) from documents) order by count(*) desc, word limit 3000),
said as (select doc_id, unnest(regexp_extract_all(text, '\p{L}+')) as word from documents),
known as (select doc_id, count(*) as words, count(*) filter (lower(word) not in (select word from familiar)) as others from said group by doc_id),
m as (select doc_id, coalesce(words, 0) as n_words, greatest(coalesce(len(regexp_extract_all(text, '[.!?]+(?:[ \t\r\n]|\z)')), 0), 1) as n_sentences, others / words as unfamiliar
      from documents left join known using (doc_id))
select doc_id, n_words, n_sentences, round(unfamiliar, 6) as unfamiliar,
       round(unfamiliar * 100 * 0.1579 + n_words / n_sentences * 0.0496 + case when unfamiliar * 100 > 5 then 3.6365 else 0 end, 6) as score
from m
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p3_scores": P3_SCORES, "p4_found": P4_FOUND, "p4_groups": P4_GROUPS, "p6_found": P6_FOUND, "p6_ranking": P6_RANKING, "p9_found": P9_FOUND, "p10_found": P10_FOUND, "p10_scores": P10_SCORES}
