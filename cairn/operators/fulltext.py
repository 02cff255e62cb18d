"""Fielded keyword search with BM25, for a batch of queries in one plan.

Two sources serve lengths, document frequencies, term counts and phrases. A :class:`StoredIndex` holds the postings of all active
documents, by buckets of terms and sorted by term, so that a batch reads the row groups of its terms and no text; it is refreshed by
the documents that changed. Without an index documents are read once: each field becomes its length and, of its terms, only
those that some query asks for, with positions. Statistics cover all active documents, whatever the scope. A larger set of terms than
``MAX_TERMS`` is met by joins instead of a list.

Scores add up over clauses and fields: boost * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / average len)), where idf is
ln(1 + (N - df + 0.5) / (df + 0.5)) and a phrase has the sum of its terms' idf. Field lengths are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.query_language import lex_clauses
from cairn.functions.scalars import filepath
from cairn.functions.text import tokens
from cairn.operators.filters import active
from cairn.operators.incremental import VersionedTarget, pending
from cairn.plans.lineage import cut
from cairn.plans.spread import spread
from cairn.schemas import BM25_B, BM25_K1, FIELD_BOOST, POSTINGS

#: Distinct query terms that may stand as a list in the plan.
MAX_TERMS = 5000
#: Clauses of a batch that may be broadcast.
MAX_CLAUSES = 200_000
#: Buckets of terms in a stored index, and documents for which a bucket has one file. Lengths stand in a bucket of their own.
BUCKETS, FILE_DOCUMENTS, LENGTHS = 16, 1_000_000, -1


def parse_queries(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """Terms of each query: key, clause (number), size (terms in it), negated, offset (in it), term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (k, i, len(c.terms), c.negated, j, t)
                for k, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for i, c in enumerate(lex_clauses(q)) for j, t in enumerate(c.terms)
            ]
            cols = list(zip(*rows)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[key, "clause", "size", "negated", "offset", "term"])

    kind = queries.schema[key].dataType.simpleString()
    return queries.select(key, text).mapInArrow(run, f"{key} {kind}, clause int, size int, negated boolean, offset int, term string")


def _fields(documents: DataFrame, body: str) -> DataFrame:
    """doc_id, field and terms of every active document."""
    texts = [("filepath", filepath(F.col("collection"), F.col("path"))), ("title", F.col("title")), ("body", F.col(body))]
    one = F.array(*[F.struct(F.lit(name).alias("field"), tokens(c).alias("terms")) for name, c in texts])
    return spread(active(documents).select("doc_id", "collection", "path", "title", body)).select("doc_id", F.inline(one))


def postings(documents: DataFrame, body: str = "text") -> DataFrame:
    """The whole index: field, term, doc_id, tf and len (terms in the field). One exchange, on (field, term, doc_id)."""
    each = _fields(documents, body).select("field", "doc_id", F.size("terms").cast("bigint").alias("len"), F.explode("terms").alias("term"))
    return each.groupBy("field", "term", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf")).select("field", "term", "doc_id", "tf", "len")


def field_stats(documents: DataFrame, body: str = "text") -> DataFrame:
    """field, n_docs (all active documents) and avg_len."""
    return _fields(documents, body).groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("terms")).alias("avg_len"))


def _entries(documents: DataFrame, body: str, salts: int) -> DataFrame:
    """Rows of a stored index: a posting for every term of a field, and for every field its length under no term.

    One exchange, by bucket and a share of the documents, so that a term of all documents is no task of its own.
    """
    version = F.xxhash64("collection", "path", "title", "hash", body)
    texts = [("filepath", filepath(F.col("collection"), F.col("path"))), ("title", F.col("title")), ("body", F.col(body))]
    one = F.array(*[F.struct(F.lit(name).alias("field"), tokens(c).alias("terms")) for name, c in texts])
    fields = spread(active(documents).select("doc_id", "collection", "path", "title", "hash", body)).select("doc_id", version.alias("version"), F.inline(one))
    placed = F.transform("terms", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("pos")))
    each = fields.select("doc_id", "version", "field", F.size("terms").cast("bigint").alias("len"), F.inline(F.concat(none, placed)))
    bucket = F.when(F.col("term").isNull(), F.lit(LENGTHS)).otherwise((F.crc32(F.encode("term", "UTF-8")) % BUCKETS).cast("int"))
    dealt = each.select("*", bucket.alias("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).repartition("bucket", "salt")
    held = dealt.groupBy("bucket", "salt", "term", "field", "doc_id", "version", "len").agg(F.count("term").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return held.select(*POSTINGS.names, "salt")


class StoredIndex:
    """Postings on disk, as a :class:`VersionedTarget`. Each document's lengths carry a hash of what was indexed of it.

    So the index is its own state: :meth:`refresh` takes in the documents whose hash it lacks and removes those that are gone or
    inactive, and a refresh that dies leaves the version before it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.target = VersionedTarget(spark, path, ["doc_id"], partition_by=["bucket"], schema=POSTINGS, sort_by=["term", "field", "doc_id"])

    def exists(self) -> bool:
        return bool(self.target.versions())

    def refresh(self, documents: DataFrame, body: str = "text") -> int | None:
        """Bring the index to the state of ``documents``; the new version, or None if nothing changed."""
        live = active(documents)
        asked = live.select("doc_id", F.xxhash64("collection", "path", "title", "hash", body).alias("version"))
        if not self.exists():
            return self.target.publish(_entries(live, body, 1 + asked.count() // FILE_DOCUMENTS))
        have = self.lengths().select("doc_id", "version").distinct()
        fresh, stale = cut(pending(asked, have, ["doc_id"], "version")), cut(pending(have, asked, ["doc_id"], "version").select("doc_id"))
        n, gone = fresh.count(), not stale.isEmpty()
        if not n and not gone:
            return None
        rows = _entries(live.join(fresh.select("doc_id"), "doc_id", "left_semi"), body, 1 + n // FILE_DOCUMENTS) if n else None
        return self.target.publish_change(rows, stale if gone else None)

    def remove(self, doc_ids: DataFrame) -> int:
        """Take the documents of column doc_id out of the index, until a refresh finds them in the catalog again."""
        return self.target.publish_change(gone=doc_ids.select("doc_id"))

    def lengths(self) -> DataFrame:
        """doc_id, field, len and version of every field."""
        return self.target.current(F.col("bucket") == LENGTHS).select("doc_id", "field", "len", "version")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, field, doc_id, tf, len, positions; of ``terms`` only, whose row groups are read and no others."""
        where = F.col("bucket") != LENGTHS
        if terms is not None:
            buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
            listed = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms)  # parsed at once, not sent one by one
            where = F.col("bucket").isin(buckets) & F.expr(f"term in ({listed})") if terms else F.lit(False)
        return self.target.current(where).select("term", "field", "doc_id", "tf", "len", "positions")


class _Hits:
    """Where the terms of a batch of queries occur: ``each`` (with positions only if some clause is a phrase), ``counts``, ``idf``."""

    def __init__(self, documents: DataFrame, terms: DataFrame, listed: list[str] | None, body: str, phrases: bool, index: StoredIndex | None):
        if index is not None:
            found = index.postings(listed) if listed is not None else index.postings().join(terms, "term", "left_semi")
            table = index.lengths()
            self.counts = found.select("field", "term", "doc_id", "len", "tf")
            self.each = found.select("doc_id", "field", "len", "term", F.explode("positions").alias("pos"))
        else:
            table = self._read(documents, terms, listed, body, phrases)
            self.counts = cut(self.each.groupBy("field", "term", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf")))
        self.stats = F.broadcast(table.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len")))  # three rows
        df = self.counts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
        self.idf = df.join(self.stats, "field").select("field", "term", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def _read(self, documents: DataFrame, terms: DataFrame, listed: list[str] | None, body: str, phrases: bool) -> DataFrame:
        found = _fields(documents, body)
        n = F.size("terms").cast("bigint").alias("len")
        placed = F.transform("terms", lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
        if listed is None:
            self.each = cut(found.select("doc_id", "field", n, F.inline(placed)).join(terms, "term", "left_semi"))
            return cut(found.select("doc_id", "field", n))
        if phrases:
            table = cut(found.select("doc_id", "field", n, F.filter(placed, lambda x: x.term.isin(listed)).alias("hits")))
            self.each = table.select("doc_id", "field", "len", F.inline("hits"))
            return table
        asked = F.filter("terms", lambda t: t.isin(listed)) if listed else F.slice("terms", 1, 0)
        table = cut(found.select("doc_id", "field", n, asked.alias("hits")))
        self.each = table.select("doc_id", "field", "len", F.explode("hits").alias("term"))
        return table


def _weight(field: Column, idf: Column) -> Column:
    """What a clause adds in a field, from tf, len and avg_len."""
    pairs = [x for name, b in FIELD_BOOST.items() for x in (F.lit(name), F.lit(b))]
    norm = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avg_len")))
    return F.element_at(F.create_map(*pairs), field) * idf * norm


def _phrase_scores(hits: _Hits, phrases: DataFrame, key: str) -> DataFrame:
    """key, negated, doc_id and weight of every phrase in every field that holds it."""
    # a phrase begins where each of its terms stands at its offset
    starts = hits.each.join(phrases, "term").withColumn("start", F.col("pos") - F.col("offset"))
    whole = starts.groupBy(key, "clause", "negated", "size", "doc_id", "field", "len", "start").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == F.col("size"))
    counted = whole.groupBy(key, "clause", "negated", "doc_id", "field", "len").agg(F.count(F.lit(1)).alias("tf"))
    idf = phrases.join(hits.idf, "term").groupBy(key, "clause", "field").agg(F.sum("idf").alias("idf"))
    return counted.join(idf, [key, "clause", "field"]).join(hits.stats, "field").select(key, "negated", "doc_id", _weight(F.col("field"), F.col("idf")).alias("s"))


def bm25_scores(documents: DataFrame, queries: DataFrame, key: str = "query_id", text: str = "query", body: str = "text", index: StoredIndex | None = None) -> DataFrame:
    """key, doc_id and raw score of every document that holds a clause of the query and none of its negated ones.

    With ``index`` it is searched, and no text is read. A query without positive clauses finds nothing. Null queries, texts and titles
    have no terms. Repeated words add up. What a word adds to a document is found once for all queries that ask for it.
    """
    parsed = parse_queries(queries, key, text)
    few = parsed.limit(MAX_CLAUSES + 1).toArrow()  # bounded: a request's words come to the driver once
    if n := few.num_rows if few.num_rows <= MAX_CLAUSES else 0:
        clauses = queries.sparkSession.createDataFrame(few)
        phrases, negations = pc.any(pc.greater(few.column("size"), 1)).as_py(), pc.any(few.column("negated")).as_py()
        listed = pc.unique(few.column("term")).to_pylist()
    elif not few.num_rows:
        clauses, phrases, negations, listed = parsed.limit(0), False, False, []
    else:
        clauses = cut(parsed)
        n, phrases, negations = clauses.agg(F.count(F.lit(1)), F.bool_or(F.col("size") > 1), F.bool_or("negated")).first()
        listed = [r[0] for r in clauses.select("term").distinct().limit(MAX_TERMS + 1).collect()]
    small = F.broadcast if n <= MAX_CLAUSES else (lambda d: d)
    hits = _Hits(documents, clauses.select("term").distinct(), listed if len(listed) <= MAX_TERMS else None, body, bool(phrases), index)
    # dealt by document once, which serves the sums by term and by query; what follows grows with the queries, so it isn't coalesced
    dealt = hits.counts.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    words = dealt.join(F.broadcast(hits.idf) if n <= MAX_CLAUSES else hits.idf, ["field", "term"]).join(hits.stats, "field")
    by_term = words.groupBy("term", "doc_id").agg(F.sum(_weight(F.col("field"), F.col("idf"))).alias("s"))
    single = clauses.where("size = 1").groupBy(key, "term", "negated").agg(F.count(F.lit(1)).alias("_m"))
    met = by_term.join(small(single), "term").select(key, "negated", "doc_id", (F.col("_m") * F.col("s")).alias("s"))
    if phrases:
        met = met.unionByName(_phrase_scores(hits, small(clauses.where("size > 1")), key))
    if not negations:
        return met.groupBy(key, "doc_id").agg(F.sum("s").alias("score"))
    both = met.groupBy(key, "doc_id").agg(F.sum(F.when(~F.col("negated"), F.col("s"))).alias("score"), F.bool_or("negated").alias("_no"))
    return both.where(F.col("score").isNotNull() & ~F.col("_no")).drop("_no")


def squashed(score: Column) -> Column:
    """From [0, inf) to [0, 1)."""
    return score / (F.lit(1.0) + score)


def search(documents: DataFrame, queries: DataFrame, limit: int, scope: DataFrame | None = None, key: str = "query_id", text: str = "query", body: str = "text", digits: int = 6, index: StoredIndex | None = None) -> DataFrame:
    """The ``limit`` best documents of each query: key, doc_id, filepath, title, hash, score in [0, 1), rank from 1.

    ``scope`` holds the doc_ids that may come out; it is applied before the cut and leaves statistics alone. Ties go to the
    smaller filepath; scores are rounded to ``digits``. ``index`` must be at the state of ``documents``.
    """
    scored = bm25_scores(documents, queries, key, text, body, index).withColumn("score", F.round(squashed(F.col("score")), digits))
    about = active(documents).select("doc_id", filepath(F.col("collection"), F.col("path")).alias("filepath"), "title", "hash")
    if scope is not None:
        scored = scored.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
    # by score alone first, so that what can't come out meets no filepath; ties with the last stay
    best = scored.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("score")))).where(F.col("_r") <= limit).drop("_r")
    order = Window.partitionBy(key).orderBy(F.desc("score"), "filepath")
    ranked = best.join(about, "doc_id").withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit)
    return ranked.select(key, "doc_id", "filepath", "title", "hash", "score", "rank")


def strong_signal(results: DataFrame, key: str = "query_id") -> DataFrame:
    """Queries whose best keyword hit is so good, and so far ahead, that expansion is needless: key, first, second, strong."""
    from cairn.schemas import STRONG_GAP, STRONG_SCORE

    two = results.where("rank <= 2").groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    return two.withColumn("strong", (F.col("first") >= STRONG_SCORE) & (F.col("first") - F.col("second") >= STRONG_GAP))
