"""Queries of the core operators over whole tables, and the SQL that computes the same with other means.

Search batches take the texts of eval_items as keyword queries, and as query vectors every stored vector (or document) whose id
is divisible by 20; what is searched is always the whole table.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.functions.backends import StubBackend
from cairn.functions.chunking import best_chunks, chunks, snippets
from cairn.functions.text import tokens
from cairn.operators import catalog, context, evaluate, filters, fulltext, fusion, hybrid, incremental, sinks, vectors
from cairn.plans.lineage import shared_dir
from cairn.streaming.ingest import windowed_counts
from cairn.tables import config_value, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _eval_queries(spark: SparkSession, d: str) -> DataFrame:
    """Keyword queries: the words of eval_items' queries, without the grammar's own signs."""
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.regexp_replace("query", r"[^\p{L}\p{N}]+", " ").alias("query"))


_FP = "collection || '/' || path"
_LIVE = "coalesce(active, true)"
#: What a walk of the collections met: the files that searches name, some of which are no documents yet. Files whose raw text is
#: not stored count as changed.
_WALKED = f"""
select split_part(filepath, '/', 1) as collection, regexp_replace(filepath, '^[^/]*/', '') as path,
       case when hash in (select hash from content) then hash else sha256('changed ' || filepath) end as hash
from (select distinct filepath from ranked where filepath is not null) r left join (select {_FP} as filepath, hash from documents) d using (filepath)
"""


def _walked(spark: SparkSession, d: str) -> DataFrame:
    met = table(spark, d, "ranked").where("filepath is not null").select("filepath").distinct()
    docs = _docs(spark, d).select(S.filepath(F.col("collection"), F.col("path")).alias("filepath"), "title", "hash", "text")
    stored = table(spark, d, "content").select("hash").distinct().withColumn("_stored", F.lit(True))
    both = met.join(docs, "filepath", "left").join(stored, "hash", "left")
    changed = F.when(F.col("_stored"), F.col("hash")).otherwise(F.sha2(F.concat(F.lit("changed "), F.col("filepath")), 256))
    return both.select(S.collection_of(F.col("filepath")).alias("collection"), S.path_of(F.col("filepath")).alias("path"), "title", changed.alias("hash"), "text")


# ---------------------------------------------------------------- incremental


@query(r"""
with kept as (
  select distinct hash, seq, total_chunks from content_vectors
  where embed_fingerprint = (select max(value) from config where key = 'embed_fingerprint') and vid is not null),
done as (
  select hash from (select hash, max(total_chunks) as total from kept group by hash) t
  where total > 0 and total = (select count(distinct seq) from kept k where k.hash = t.hash and seq >= 0 and seq < t.total))
select doc_id from documents
where coalesce(active, true) and regexp_matches(text, '[^\s\x{85}\x1c-\x1f\p{Z}]')
  and (hash is null or hash not in (select hash from done))
""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = config_value(spark, sf_dir, "embed_fingerprint")
    return incremental.pending_documents(_docs(spark, sf_dir), table(spark, sf_dir, "content_vectors"), now).select("doc_id")


# ---------------------------------------------------------------- catalog


@query(f"select collection, count(*) as n_documents, max(modified_at) as last_modified from documents where {_LIVE} group by collection")
def doc_stats_by_collection(spark, d):
    return catalog.collection_stats(_docs(spark, d))


@query("select hash, min(doc_id) as doc_id, count(*) as n from documents where hash is not null group by hash")
def content_dedup_first(spark, d):
    docs = _docs(spark, d).where("hash is not null")
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("select d.hash, min(created_at) as created_at from documents d where d.hash is not null and d.hash not in (select hash from content) group by d.hash")
def new_content(spark, d):
    incoming = _docs(spark, d).select("hash", F.col("text").alias("doc"), "created_at")
    return catalog.new_content(table(spark, d, "content"), incoming).select("hash", "created_at")


@query(f"""
with w as ({_WALKED})
select w.collection, w.path, case when d.doc_id is null then 'new' when not coalesce(d.active, true) then 'reactivated'
       when d.hash is not distinct from w.hash then 'unchanged' else 'updated' end as outcome
from w left join documents d on d.collection = w.collection and d.path = w.path
""")
def change_classification(spark, d):
    return catalog.classify(_docs(spark, d), _walked(spark, d)).select("collection", "path", "outcome")


@query(f"""
with w as ({_WALKED}),
m as (select d.doc_id, d.collection, d.path, d.hash, d.modified_at, d.active, d.created_at, w.hash as h, w.path is not null and (not coalesce(d.active, true) or d.hash is distinct from w.hash) as changed
      from documents d left join w on d.collection = w.collection and d.path = w.path),
n as (select w.collection, w.path, w.hash, row_number() over (order by w.collection, w.path) as k from w left join documents d on d.collection = w.collection and d.path = w.path where d.doc_id is null)
select doc_id, collection, path, case when changed then h else hash end as hash, case when changed then '2026-01-01T00:00:00Z' else modified_at end as modified_at,
       case when changed then true else active end as active, created_at from m
union all
select k + (select max(doc_id) from documents), collection, path, hash, '2026-01-01T00:00:00Z', true, '2026-01-01T00:00:00Z' from n
""")
def upsert_documents(spark, d):
    return catalog.upsert_documents(_docs(spark, d), _walked(spark, d), "2026-01-01T00:00:00Z").select("doc_id", "collection", "path", "hash", "modified_at", "active", "created_at")


@query(f"""
with w as ({_WALKED})
select doc_id, {_FP} as filepath from documents d where {_LIVE} and collection in (select collection from w)
  and not exists (select 1 from w where w.collection = d.collection and w.path = d.path)
""")
def soft_delete_missing(spark, d):
    gone = catalog.missing_documents(_docs(spark, d), _walked(spark, d))
    return gone.select("doc_id", S.filepath(F.col("collection"), F.col("path")).alias("filepath"))


@query("select hash from content where hash not in (select hash from documents where collection = 'inbox' and hash is not null) or hash in (select hash from documents where collection <> 'inbox' and hash is not null)")
def purge_collection(spark, d):
    t = {n: table(spark, d, n) for n in ("documents", "content", "content_vectors", "collections")}
    return catalog.purge_collection(t["documents"], t["content"], t["content_vectors"], t["collections"], "inbox")["content"].select("hash")


@query(r"select distinct hash from documents where coalesce(active, true) and hash is not null and regexp_matches(text, '[^\s\x{85}\x1c-\x1f\p{Z}]') and hash not in (select hash from content_vectors where hash is not null)")
def pending_embed(spark, d):
    return catalog.pending_hashes(_docs(spark, d), table(spark, d, "content_vectors"))


@query(f"select distinct hash, seq, vid from content_vectors where hash not in (select hash from documents where {_LIVE} and hash is not null)")
def orphan_vectors(spark, d):
    return catalog.orphan_vectors(table(spark, d, "content_vectors"), _docs(spark, d)).select("hash", "seq", "vid").distinct()


@query("select embed_fingerprint, count(*) as n from content_vectors where embed_fingerprint <> '' group by embed_fingerprint")
def fingerprint_breakdown(spark, d):
    return catalog.fingerprints(table(spark, d, "content_vectors"))


@query("select distinct embed_fingerprint from content_vectors where embed_fingerprint <> '' and embed_fingerprint <> (select max(value) from config where key = 'embed_fingerprint')")
def stale_fingerprints(spark, d):
    return catalog.stale_fingerprints(table(spark, d, "content_vectors"), config_value(spark, d, "embed_fingerprint"))


@query("""
with k as (select hash, seq, row_number() over (order by hash, seq) as n from (select distinct hash, seq from content_vectors where vid is null))
select hash, seq, n + (select coalesce(max(vid), -1) from content_vectors) as vid from k
""")
def vid_allocation(spark, d):
    stored = table(spark, d, "content_vectors")
    fresh = stored.where("vid is null").select("hash", "seq").distinct()
    return catalog.allocate_vids(stored, fresh)


@query("""
with r as (select hash, seq, vid, row_number() over (partition by hash, seq order by vid desc nulls last) as r from content_vectors where embed_fingerprint <> ''),
n as (select hash, seq, vid from r where r = 1)
select hash, seq, vid from n union all
select hash, seq, vid from content_vectors v where embed_fingerprint = '' and not exists (select 1 from n where n.hash = v.hash and n.seq = v.seq)
""")
def upsert_vectors(spark, d):
    stored = table(spark, d, "content_vectors")
    return catalog.upsert_vectors(stored.where("embed_fingerprint = ''"), stored.where("embed_fingerprint <> ''")).select("hash", "seq", "vid")


@query("select key, value from config where starts_with(key, 'context:doc://r')")
def config_prefix(spark, d):
    return catalog.config_by_prefix(table(spark, d, "config"), "context:doc://r")


@query(f"""
with s as (select collection, count(*) as n, max(modified_at) as m from documents where {_LIVE} group by collection)
select name, coalesce(n, 0) as n_documents, m as last_modified, coalesce(include_by_default, true) as included,
       'context:doc://' || name || '/' not in (select key from config where value is not null) as lacks_context, coalesce(update_command, '') = '' as lacks_command
from collections left join s on s.collection = name
""")
def collection_report(spark, d):
    return catalog.collection_report(table(spark, d, "collections"), _docs(spark, d), table(spark, d, "config"))


@query(rf"""
select (select count(*) from documents where {_LIVE}) as n_documents, (select max(modified_at) from documents where {_LIVE}) as last_modified,
       (select count(*) from content_vectors) as n_vectors,
       (select count(distinct hash) from documents where {_LIVE} and regexp_matches(text, '[^\s\x{{85}}\x1c-\x1f\p{{Z}}]') and hash not in (select hash from content_vectors where hash is not null)) as n_pending
""")
def status(spark, d):
    return catalog.status(_docs(spark, d), table(spark, d, "content_vectors"))


@query(rf"""
with c as (
select 'collections' as "check", (select count(*) from collections) as value, 'warning' as zero, 'ok' as above union all
select 'stale fingerprints', (select count(distinct embed_fingerprint) from content_vectors where embed_fingerprint <> '' and embed_fingerprint <> (select max(value) from config where key = 'embed_fingerprint')), 'ok', 'warning' union all
select 'orphaned vectors', (select count(*) from content_vectors where hash not in (select hash from documents where {_LIVE} and hash is not null)), 'ok', 'warning' union all
select 'pending hashes', (select count(distinct hash) from documents where {_LIVE} and regexp_matches(text, '[^\s\x{{85}}\x1c-\x1f\p{{Z}}]') and hash not in (select hash from content_vectors where hash is not null)), 'ok', 'note')
select "check", case when value > 0 then above else zero end as severity, value from c
""")
def doctor(spark, d):
    return catalog.doctor(_docs(spark, d), table(spark, d, "content_vectors"), table(spark, d, "collections"), config_value(spark, d, "embed_fingerprint"))


# ---------------------------------------------------------------- filters, lookups, contexts


@query(f"""
select doc_id from documents where {_LIVE} and (
  collection in (select name from collections where coalesce(include_by_default, true)) or not exists (select 1 from collections))
""")
def default_scope(spark, d):
    return filters.default_scope(filters.active(_docs(spark, d)), table(spark, d, "collections")).select("doc_id")


@query(f"""
with p as (select unnest(['a', '0', 'ff', 'zz', '3b']) as docid),
r as (select docid, doc_id, hash, row_number() over (partition by docid order by collection, path) as r from documents join p on starts_with(hash, docid) where {_LIVE})
select docid, doc_id, hash from r where r = 1
""")
def docid_lookup(spark, d):
    return filters.by_docid(_docs(spark, d), ["#a", "0", "ff", "#zz", "3b"]).select("docid", "doc_id", "hash")


@query("select doc_id, sha256(text) as hash, substr(sha256(text), 1, 6) as docid from documents where text is not null")
def content_ids(spark, d):
    docs = catalog.with_hash(_docs(spark, d).where("text is not null").drop("hash"))
    return docs.select("doc_id", "hash", S.docid(F.col("hash")).alias("docid"))


@query(f"select doc_id from documents where {_LIVE} and (ends_with('/' || path, '/the.md') or ends_with('/' || {_FP}, '/the.md') or ends_with('/' || {_FP}, '/the-plan.md') or path = (select min(path) from documents) or ends_with('/' || {_FP}, '/' || (select min(path) from documents)))")
def needle_match(spark, d):
    least = _docs(spark, d).agg(F.min("path")).first()[0]
    return filters.by_needles(_docs(spark, d), ["the.md", "the-plan.md", least]).select("doc_id")


@query(f"select doc_id from documents where {_LIVE} and regexp_matches({_FP}, '(?s)^(home|runbooks)/.*-plan-[a-m].*[.]md$')")
def glob_match(spark, d):
    return filters.by_glob(_docs(spark, d), "{home,runbooks}/*-plan-[a-m]*.md").select("doc_id")


@query(f"""
select doc_id, collection, path from documents where {_LIVE} and (
  regexp_matches({_FP}, '(?s)^runbooks/.*notes.*$') or ends_with('/' || path, '/the.md')
  or doc_id = (select doc_id from documents where {_LIVE} and starts_with(hash, 'a') order by collection, path limit 1))
""")
def multi_get(spark, d):
    return filters.multi_get(_docs(spark, d), "runbooks/*notes*, #a, the.md, doc://the.md").select("doc_id", "collection", "path")


@query(f"select doc_id, path from documents where {_LIVE} and collection = 'runbooks' and starts_with(path, 'guide')")
def list_paths(spark, d):
    return filters.list_paths(_docs(spark, d), "runbooks/guide").select("doc_id", "path")


@query(f"""
with recursive a as (
  select doc_id, collection, path, regexp_replace(path, '/?[^/]*$', '') as dir, 0 as near from documents where {_LIVE}
  union all select doc_id, collection, path, regexp_replace(dir, '/?[^/]*$', ''), near + 1 from a where dir <> ''),
k as (select doc_id, case when dir = '' then 'context:doc://' || collection || '/' else 'context:doc://' || collection || '/' || dir || '/' end as key, near from a
      union all select doc_id, 'context:/', 1000000 from documents where {_LIVE}),
f as (select doc_id, arg_min(value, near) as context from k join config using (key) where value is not null group by doc_id)
select doc_id, context from documents left join f using (doc_id) where {_LIVE}
""")
def context_inheritance(spark, d):
    docs = filters.active(_docs(spark, d)).select("doc_id", "collection", "path")
    return context.with_context(docs, table(spark, d, "config"), ["doc_id"]).select("doc_id", "context")


@query("select name from collections where 'context:doc://' || name || '/' not in (select key from config where value is not null)")
def lacking_context(spark, d):
    return context.lacking_context(table(spark, d, "collections"), table(spark, d, "config"))


@query(f"select doc_id, coalesce(doc, '') as body from documents left join content using (hash) where {_LIVE}")
def documents_with_body(spark, d):
    return filters.with_body(filters.active(_docs(spark, d)), table(spark, d, "content")).select("doc_id", "body")


# ---------------------------------------------------------------- full text


def _toks(c: str) -> str:
    return rf"list_filter(coalesce(regexp_extract_all(lower(replace({c}, 'İ', 'i')), '[\p{{L}}\p{{N}}]+'), []), lambda t: strlen(t) < 40)"


_FIELDS = f"""
d as (select doc_id, {_FP} as filepath, title, text, collection from documents where {_LIVE}),
f as (select doc_id, 'filepath' as field, {_toks('filepath')} as w from d union all
      select doc_id, 'title', {_toks('title')} from d union all select doc_id, 'body', {_toks('text')} from d),
stats as (select field, count(*) as n_docs, avg(len(w)) as avg_len from f group by field)
"""


@query(f"with {_FIELDS} select field, n_docs, round(avg_len, 6) as avg_len from stats")
def corpus_stats(spark, d):
    return fulltext.field_stats(_docs(spark, d)).withColumn("avg_len", F.round("avg_len", 6))


@query(f"with {_FIELDS}, t as (select field, doc_id, len(w)::bigint as len, unnest(w) as term from f) select field, term, doc_id, len, count(*) as tf from t group by all")
def postings(spark, d):
    return fulltext.postings(_docs(spark, d))


@query(f"with {_FIELDS}, t as (select doc_id, unnest(w) as term from f where field = 'body') select term, count(*) as n, count(distinct doc_id) as docs from t group by term")
def token_stats(spark, d):
    each = filters.active(_docs(spark, d)).select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy("term").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs"))


_indexes: dict[tuple[str, str], fulltext.StoredIndex] = {}


def _index(spark: SparkSession, d: str) -> fulltext.StoredIndex:
    """The stored index of the directory's documents, in the shared folder; built by the first query of an application that needs it."""
    name = (spark.sparkContext.applicationId, os.path.abspath(d) if "://" not in d else d)
    if name not in _indexes:
        index = fulltext.StoredIndex(spark, f"{shared_dir(spark)}/cairn-index-{uuid.uuid4().hex}")
        index.refresh(_docs(spark, d))
        _indexes[name] = index
    return _indexes[name]


@query(f"""
with {_FIELDS.replace(f"select doc_id, {_FP} as filepath, title, text, collection from documents where {_LIVE}", f"select doc_id, {_FP} as filepath, case when collection = 'memos' then 'Renewed ' || coalesce(title, '') else title end as title, text, collection from documents where {_LIVE} and collection <> 'specs'")},
t as (select field, doc_id, unnest(w) as term from f),
o as (select field, term, doc_id, count(*) as tf from t group by all)
select field, term, count(*) as docs, sum(tf) as n, 0::bigint as len from o group by field, term
union all select field, null, count(*), 0, sum(len(w)) from f group by field
""")
def index_update(spark, d):
    """A stored index that met first all documents, then a catalog in which a collection is gone and another's titles changed."""
    documents = _docs(spark, d)
    index = fulltext.StoredIndex(spark, f"{shared_dir(spark)}/cairn-index-{uuid.uuid4().hex}")
    index.refresh(documents)
    changed = documents.where("collection <> 'specs'").withColumn("title", F.when(F.col("collection") == "memos", F.concat(F.lit("Renewed "), F.coalesce("title", F.lit("")))).otherwise(F.col("title")))
    index.refresh(changed)
    terms = index.postings().groupBy("field", "term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("n"), F.lit(0).cast("bigint").alias("len"))
    lengths = index.lengths().groupBy("field").agg(F.lit(None).cast("string").alias("term"), F.count(F.lit(1)).alias("docs"), F.lit(0).cast("bigint").alias("n"), F.sum("len").alias("len"))
    return terms.unionByName(lengths)


def _bm25(scope: str = "true", limit: int = 10) -> str:
    clean = r"regexp_replace(query, '[^\p{L}\p{N}]+', ' ', 'g')"
    return f"""
{_FIELDS},
q as (select item_id as query_id, unnest({_toks(clean)}) as term from eval_items),
occ as (select field, doc_id, len, term, count(*) as tf from (select field, doc_id, len(w) as len, unnest(w) as term from f) where term in (select term from q) group by all),
idf as (select field, term, ln(1 + (max(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) as idf from occ join stats using (field) group by all),
scored as (
  select query_id, doc_id, sum(case field when 'filepath' then 1.5 when 'title' then 4.0 else 1.0 end * idf * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / avg_len))) as s
  from q join occ using (term) join idf using (field, term) join stats using (field) group by all),
hits as (select query_id, doc_id, filepath, round(s / (1 + s), 6) as score from scored join d using (doc_id) where {scope}),
ranked as (select *, row_number() over (partition by query_id order by score desc, filepath) as rank from hits),
top as (select * from ranked where rank <= {limit})
"""


@query(f"with {_bm25()} select query_id, doc_id, filepath, score, rank from top")
def bm25_batch(spark, d):
    return fulltext.search(_docs(spark, d), _eval_queries(spark, d), 10, index=_index(spark, d)).select("query_id", "doc_id", "filepath", "score", "rank")


@query(f"with {_bm25(scope='collection in (' + chr(39) + 'specs' + chr(39) + ', ' + chr(39) + 'memos' + chr(39) + ')')} select query_id, doc_id, filepath, score, rank from top")
def bm25_scoped(spark, d):
    scope = filters.in_collections(_docs(spark, d), ["specs", "memos"])
    return fulltext.search(_docs(spark, d), _eval_queries(spark, d), 10, scope, index=_index(spark, d)).select("query_id", "doc_id", "filepath", "score", "rank")


@query(f"""
with {_bm25(limit=2)}
select query_id, first, second, first >= 0.85 and first - second >= 0.15 as strong
from (select query_id, max(case when rank = 1 then score end) as first, coalesce(max(case when rank = 2 then score end), 0) as second from top group by query_id)
""")
def strong_signal(spark, d):
    return fulltext.strong_signal(fulltext.search(_docs(spark, d), _eval_queries(spark, d), 2, index=_index(spark, d)))


def _marked(words: str) -> str:
    """Documents holding a phrase in some field, as SQL."""
    return f"(select distinct doc_id from f where contains(' ' || array_to_string(w, ' ') || ' ', ' {words} '))"


@query(f"""
with {_FIELDS}
select 1::bigint as query_id, doc_id from {_marked('the platform crew')} union all
select 2::bigint, doc_id from {_marked('on call person')} where doc_id not in (select doc_id from {_marked('budget')}) union all
select 3::bigint, doc_id from {_marked('the second')} where doc_id not in (select doc_id from {_marked('gave up on')})
""")
def phrase_and_negation(spark, d):
    asked = spark.createDataFrame([(1, '"the platform crew"'), (2, "on-call-person -budget"), (3, '"The Second" -"gave up on"'), (4, "-budget")], "query_id bigint, query string")
    return fulltext.bm25_scores(_docs(spark, d), asked, index=_index(spark, d)).select("query_id", "doc_id")


@query(f"""
with {_bm25()},
e as (select item_id as query_id, expected_doc, difficulty from eval_items),
h as (select e.query_id, e.difficulty, min(case when contains(lower(filepath), expected_doc) then rank end) as first from e left join top using (query_id) group by all),
x as (select unnest([difficulty, 'all']) as difficulty, first from h), k as (select unnest([1, 3, 5, 10])::int as k)
select difficulty, k, count(*) as n, count(*) filter (first <= k) as hits, round(count(*) filter (first <= k) / count(*), 6) as rate from x, k group by all
""")
def hit_at_k(spark, d):
    results = fulltext.search(_docs(spark, d), _eval_queries(spark, d), 10, index=_index(spark, d))
    expected = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "expected_doc", "difficulty")
    return evaluate.hit_rates(results, expected)


@query(f"""
select doc_id, case when collection = 'memos' then 'changed ' else '' end || coalesce(hash, 'none') as version, case when collection in ('memos', 'specs') then 2 else 1 end as run
from documents
""")
def incremental_resume(spark, d):
    """A target after a run without a collection, a run that died on new and changed records, and its repetition."""
    docs = _docs(spark, d).select("doc_id", "collection", F.coalesce("hash", F.lit("none")).alias("version"))
    target = incremental.VersionedTarget(spark, f"{shared_dir(spark)}/cairn-target-{uuid.uuid4().hex}", ["doc_id"])
    target.run(docs.where("collection <> 'specs'"), ["doc_id"], "version", lambda new: new.select("doc_id", "version", F.lit(1).alias("run")))
    changed = docs.withColumn("version", F.when(F.col("collection") == "memos", F.concat(F.lit("changed "), "version")).otherwise(F.col("version")))
    half_done = target._write(changed.select("doc_id", "version", F.lit(9).alias("run")), "2")  # written, never published
    target.run(changed, ["doc_id"], "version", lambda new: new.select("doc_id", "version", F.lit(2).alias("run")))
    assert half_done not in {f for p in target.manifest(2) for f in p.values()}
    return target.current().select("doc_id", "version", "run")


# ---------------------------------------------------------------- vectors and fusion

_VECTORS = """
n as (select vid, hash, seq, list_transform(embedding, lambda x: coalesce(x, 'nan'::float)::double) as e from content_vectors where vid is not null and len(embedding) = 64),
v as (select vid, any_value(hash) as hash, any_value(seq) as seq, min(e) as e from n where not isnan(list_sum(e)) and list_dot_product(e, e) > 0 group by vid)
"""


def _one_per_vid(spark: SparkSession, d: str) -> DataFrame:
    """Vectors without rows that were written twice."""
    good = vectors.usable(table(spark, d, "content_vectors").where("vid is not null"), dim=64)
    return good.groupBy("vid").agg(F.min(F.struct("embedding", "hash", "seq")).alias("_m")).select("vid", "_m.hash", "_m.seq", "_m.embedding")


@query(f"""
with {_VECTORS},
p as (select q.vid as query_id, v.vid, round(list_cosine_similarity(q.e, v.e), 6) as score from v q join v on q.vid % 20 = 0 and v.vid <> q.vid),
r as (select *, row_number() over (partition by query_id order by score desc, vid) as rank from p)
select query_id, vid, score, rank from r where rank <= 10
""")
def vector_topk(spark, d):
    mine = _one_per_vid(spark, d)
    asked = mine.where("vid % 20 = 0").select(F.col("vid").alias("query_id"), "embedding")
    return vectors.nearest(mine, asked, 10, not_own=True)


@query(f"""
with {_VECTORS},
d as (select hash, {_FP} as filepath from documents where {_LIVE}),
p as (select q.vid as query_id, filepath, round(max(list_cosine_similarity(q.e, v.e)), 6) as score from v q join v on q.vid % 20 = 0 join d on d.hash = v.hash group by all),
r as (select *, row_number() over (partition by query_id order by score desc, filepath) as rank from p)
select query_id, filepath, score, rank from r where rank <= 10
""")
def vector_best_chunk_per_doc(spark, d):
    mine = _one_per_vid(spark, d)
    asked = mine.where("vid % 20 = 0").select(F.col("vid").alias("query_id"), "embedding")
    return vectors.vsearch(mine, _docs(spark, d), asked, 10)


@query(f"""
with {_VECTORS},
d as (select doc_id, hash, {_FP} as filepath from documents where {_LIVE}),
s as (select doc_id, filepath as own, e from (select doc_id, {_FP} as filepath, e, row_number() over (partition by doc_id order by seq, vid) as r from documents join v using (hash) where doc_id % 20 = 0) where r <= 8),
p as (select s.doc_id, d.filepath, round(max(list_cosine_similarity(s.e, v.e)), 6) as score from s, v join d on d.hash = v.hash where d.filepath <> s.own group by all),
r as (select *, row_number() over (partition by doc_id order by score desc, filepath) as rank from p)
select doc_id, filepath, score, rank from r where rank <= 5
""")
def similar_docs(spark, d):
    return vectors.similar(_one_per_vid(spark, d), _docs(spark, d), _docs(spark, d).where("doc_id % 20 = 0"), 5)


@query(f"with {_VECTORS} select vid, round(list_sum(list_transform(e, lambda x: (x / greatest(sqrt(list_dot_product(e, e)), 1e-12))::float::double)), 4) as total from v")
def l2_normalize(spark, d):
    return _one_per_vid(spark, d).select("vid", F.round(F.aggregate(vectors.normalized(F.col("embedding")), F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


_FUSED = """
best as (select query_id, list_id, filepath, max(backend_score) as s, arg_max(weight, (backend_score, weight)) as weight from ranked where backend_score is not null and filepath is not null group by all),
placed as (select *, row_number() over (partition by query_id, list_id order by s desc, filepath) - 1 as r from best),
summed as (select query_id, filepath, sum(weight / (61 + r)) as s, min(r) as best_rank, count(*) as n_lists from placed group by all),
scored as (select query_id, filepath, round(s + case when best_rank = 0 then 0.05 when best_rank <= 2 then 0.02 else 0 end, 6) as score, best_rank, n_lists from summed),
fused as (select *, row_number() over (partition by query_id order by score desc, filepath) as position from scored)
"""


@query(f"with {_FUSED} select query_id, filepath, score, best_rank, n_lists, position from fused where position <= 20")
def rrf_fuse(spark, d):
    return fusion.fuse(table(spark, d, "ranked"), 20)


@query(f"""
with {_FUSED},
r as (select query_id, filepath, (position * 37 % 100) / 100.0::double as rr from fused where position <= 20 and filepath in (select collection || '/' || path from documents)),
m as (select query_id, filepath, best_rank, n_lists, round(coalesce(0.75 * rr + 0.25 * score, score), 9) as score from fused left join r using (query_id, filepath) where position <= 20),
z as (select *, row_number() over (partition by query_id order by score desc, filepath) as position from m)
select query_id, filepath, score, best_rank, n_lists, position from z where position <= 10
""")
def rerank_blend(spark, d):
    fused = fusion.fuse(table(spark, d, "ranked"), 20)
    known = _docs(spark, d).select(S.filepath(F.col("collection"), F.col("path")).alias("filepath"))
    given = fused.join(known, "filepath", "left_semi").select("query_id", "filepath", (F.col("position") * 37 % 100 / 100.0).alias("rerank_score"))
    return fusion.blend(fused, given, 10, digits=9)


@query(f"""
with {_bm25(limit=20)}, {_VECTORS.replace('n as', 'vn as').replace('from n ', 'from vn ')},
o as (select item_id as query_id, list_sum(list_transform(range(1, strlen(w) + 1), lambda i: ascii(substr(w, i, 1)))) % 64 as slot
      from (select item_id, regexp_extract(query, '^\\s*(\\S*)', 1) as w from eval_items)),
vp as (select query_id, filepath, round(max(coalesce(e[slot::int + 1], 0) / sqrt(list_dot_product(e, e))), 6) as score from o, v join d on true join documents using (doc_id) where documents.hash = v.hash group by all),
vr as (select *, row_number() over (partition by query_id order by score desc, filepath) as rank from vp),
lists as (select query_id, filepath, rank - 1 as r from top union all select query_id, filepath, rank - 1 from vr where rank <= 20),
s as (select query_id, filepath, sum(2.0::double / (61 + r)) as s, min(r) as best_rank from lists group by all),
z as (select query_id, filepath, round(s + case when best_rank = 0 then 0.05 when best_rank <= 2 then 0.02 else 0 end, 6) as score from s),
y as (select *, row_number() over (partition by query_id order by score desc, filepath) as position from z)
select query_id, filepath, score, position from y where position <= 10
""")
def hybrid_topk(spark, d):
    asked = [(r.query_id, r.query.strip()) for r in _eval_queries(spark, d).collect()]  # the held-out items: a request
    found = hybrid.hybrid_search(asked, _docs(spark, d), table(spark, d, "content"), _one_per_vid(spark, d), StubBackend(64), limit=10, rerank=False, expand=False, index=_index(spark, d))
    return found.select("query_id", "filepath", "score", "position")


@query("select list_source, count(*) as n, avg(backend_score) as mean, quantile_disc(backend_score, 0.5) as p50, quantile_disc(backend_score, 0.99) as p99 from ranked where backend_score is not null group by list_source")
def score_percentiles(spark, d):
    return evaluate.latency_summary(table(spark, d, "ranked"), ["list_source"], "backend_score")


# ---------------------------------------------------------------- chunks, snippets, text


@query()
def chunk_documents(spark, d):
    return chunks(table(spark, d, "content").select("hash", "doc"), "doc").select("hash", "seq", "pos", "total_chunks", F.length("chunk").alias("n_chars"))


@query()
def best_chunk_overlap(spark, d):
    pieces = chunks(table(spark, d, "content").select("hash", "doc"), "doc").withColumn("terms", F.array(*[F.lit(t) for t in ("budget", "second", "the platform")]))
    return best_chunks(pieces, ["hash"]).select("hash", "seq", "pos")


@query(r"""
with l as (select doc_id, unnest(range(1, len(s) + 1)) as i, s from (select doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) as s from documents where text is not null and text <> '')),
x as (select doc_id, i, (contains(lower(s[i]), 'budget')::int + contains(lower(s[i]), 'second')::int) as hits from l)
select doc_id, arg_max(i, (hits, -i))::bigint as line from x group by doc_id
""")
def best_line(spark, d):
    rows = _docs(spark, d).where("text is not null and text <> ''").select("doc_id", F.col("text").alias("body"), F.lit("Budget second").alias("query"), F.lit(0).cast("bigint").alias("best_chunk_pos"), F.lit("").alias("best_chunk"))
    return snippets(rows).select("doc_id", "line")


@query()
def json_results(spark, d):
    asked = [(r.query_id, r.query.strip()) for r in _eval_queries(spark, d).collect()]
    found = hybrid.hybrid_search(asked, _docs(spark, d), table(spark, d, "content"), _one_per_vid(spark, d), StubBackend(64), limit=10, rerank=True, expand=False, index=_index(spark, d))
    return sinks.json_documents(context.with_context(found, table(spark, d, "config"), ["query_id", "position"]))


@query(r"""
select doc_id, regexp_replace(regexp_replace(title, '(plan)', '**\1**', 'gi'), '(the)', '**\1**', 'gi') as marked,
       case when contains(title, ',') or contains(title, '"') or contains(title, chr(10)) then '"' || replace(title, '"', '""') || '"' else title end as csv,
       replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as xml
from documents
""")
def text_escapes(spark, d):
    t = F.col("title")
    return _docs(spark, d).select("doc_id", S.highlight(t, ["plan", "a", "the"]).alias("marked"), S.csv_field(t).alias("csv"), S.xml_escape(t).alias("xml"))


@query(r"""
with p as (select doc_id, modified_at as m, case when regexp_full_match(modified_at, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z') then date_diff('second', strptime(modified_at, '%Y-%m-%dT%H:%M:%SZ'), timestamp '2025-12-31 12:00:00') end as age from documents)
select doc_id, case when age is null then m when age < 60 then 'just now' when age < 3600 then (age // 60) || 'm ago' when age < 86400 then (age // 3600) || 'h ago'
       when age < 604800 then (age // 86400) || 'd ago' else substr(m, 1, 10) end as age from p
""")
def time_ago(spark, d):
    return _docs(spark, d).select("doc_id", S.time_ago(F.col("modified_at"), F.lit("2025-12-31 12:00:00").cast("timestamp")).alias("age"))


@query(f"select doc_id, {_FP} as filepath, split_part({_FP}, '/', 1) as collection, regexp_replace({_FP}, '^[^/]*/', '') as path from documents")
def filepath_parts(spark, d):
    full = S.filepath(F.col("collection"), F.col("path"))
    return _docs(spark, d).select("doc_id", full.alias("filepath"), S.collection_of(full).alias("collection"), S.path_of(full).alias("path"))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by all")
def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", ["event_type"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
