"""The relational catalog: content, documents, vectors, collections and settings, as transformations from tables to tables.

No operator changes anything in place. Each returns the new table (or the rows to add), which the store publishes as a version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.chunking import chunks
from cairn.functions.scalars import content_hash, embed_fingerprint, filepath
from cairn.functions.text import is_blank
from cairn.operators.filters import active, in_collections, is_active
from cairn.plans.lineage import cut
from cairn.plans.ranking import numbered
from cairn.schemas import DEFAULT_PATTERN

# ---------------------------------------------------------------- content and documents


def new_content(content: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` (hash, doc, created_at) to append: hashes not stored yet, the first by (created_at, doc) of each.

    What is stored is never replaced. Null hashes are left out.
    """
    fresh = incoming.where(F.col("hash").isNotNull()).join(content.select("hash").distinct(), "hash", "left_anti")
    first = fresh.groupBy("hash").agg(F.min(F.struct("created_at", "doc")).alias("_m"))
    return first.select("hash", F.col("_m.doc").alias("doc"), F.col("_m.created_at").alias("created_at"))


def classify(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` (collection, path, title, hash, ...) with ``outcome``: new, updated, unchanged, or reactivated.

    A document set inactive that comes back counts as reactivated, whatever its hash. Extra columns are kept.
    """
    have = documents.select("collection", "path", F.col("hash").alias("_h"), is_active().alias("_a"))
    both = incoming.join(have, ["collection", "path"], "left")
    outcome = F.when(F.col("_a").isNull(), "new").when(~F.col("_a"), "reactivated").when(F.col("_h").eqNullSafe(F.col("hash")), "unchanged").otherwise("updated")
    return both.withColumn("outcome", outcome).drop("_h", "_a")


_PATH = ["collection", "path"]


def _settled(incoming: DataFrame) -> DataFrame:
    """One row of (collection, path) each, with its title, hash and text as ``_n``: of several the one with the largest (hash, title)."""
    return incoming.groupBy(*_PATH).agg(F.max(F.struct("hash", "title", "text")).alias("_n"))


def _taken(columns: list[str], changed: Column | None, now: str) -> list[Column]:
    """``columns`` of a stored document joined to its ``_n``, with what a change sets where ``changed`` holds (everywhere if None)."""
    pick = {"title": F.col("_n.title"), "hash": F.col("_n.hash"), "text": F.col("_n.text"), "modified_at": F.lit(now), "active": F.lit(True)}
    return [F.col(c) if c not in pick else (pick[c] if changed is None else F.when(changed, pick[c]).otherwise(F.col(c))).alias(c) for c in columns]


def _added(documents: DataFrame, one: DataFrame, now: str) -> DataFrame:
    """Rows for what the documents lack, with ids above the largest."""
    fresh = one.join(documents.select(*_PATH), _PATH, "left_anti").select(*_PATH, F.col("_n.title").alias("title"), F.col("_n.hash").alias("hash"), F.col("_n.text").alias("text"))
    top = documents.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("_top"))
    placed = with_dense_ids(fresh, _PATH, "_n").crossJoin(F.broadcast(top))  # one row
    return placed.select((F.col("_top") + F.col("_n")).alias("doc_id"), *_PATH, "title", "hash", "text", F.lit(now).alias("created_at"), F.lit(now).alias("modified_at"), F.lit(True).alias("active"))


def upsert_documents(documents: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """The documents after taking in ``incoming`` (collection, path, title, hash, text).

    A (collection, path) that exists keeps doc_id and created_at; if its hash changed or it was inactive, title, hash, text and
    modified_at change and it becomes active; else nothing does. New ones get ids above the largest. Of repeated incoming keys
    the row with the largest (hash, title) counts. Columns of ``documents`` beside these are kept for old rows and null for new.
    """
    one = _settled(incoming)
    changed = F.col("_n").isNotNull() & (~F.col("hash").eqNullSafe(F.col("_n.hash")) | ~is_active())
    kept = documents.join(one, _PATH, "left").select(*_taken(documents.columns, changed, now))
    return kept.unionByName(_added(documents, one, now), allowMissingColumns=True)


def document_change(documents: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """The rows that :func:`upsert_documents` changes or adds. No stored text is read for them."""
    one = _settled(incoming)
    met = documents.drop("title", "text").join(one, _PATH).where(~F.col("hash").eqNullSafe(F.col("_n.hash")) | ~is_active())
    return met.select(*_taken(documents.columns, None, now)).unionByName(_added(documents, one, now), allowMissingColumns=True)


def with_dense_ids(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with numbers from 1 by ``order``, made by range partitions and their sizes rather than in one task."""
    return numbered(df.withColumn("_all", F.lit(0)), ["_all"], [F.asc(c) for c in order], out).drop("_all")


def missing_documents(documents: DataFrame, walked: DataFrame, collection: str | None = None) -> DataFrame:
    """Active documents that a walk (collection, path) didn't meet, in ``collection`` or in every collection that was walked.

    A collection in which the walk met nothing is left alone.
    """
    met = walked.select("collection").distinct()
    mine = active(documents).join(met, "collection", "left_semi")
    if collection is not None:
        mine = mine.where(F.col("collection") == collection)
    return mine.join(walked.select("collection", "path"), ["collection", "path"], "left_anti")


def deactivate(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """``documents`` in which those of ``gone`` (doc_id) are inactive."""
    marks = gone.select("doc_id").distinct().withColumn("_gone", F.lit(True))
    return documents.join(marks, "doc_id", "left").withColumn("active", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("active"))).drop("_gone").select(*documents.columns)


def purge_collection(documents: DataFrame, content: DataFrame, vectors: DataFrame, collections: DataFrame, name: str) -> dict[str, DataFrame]:
    """All four tables without the collection. Content and vectors stay while any other document, active or not, has the hash."""
    rest = documents.where(~F.col("collection").eqNullSafe(F.lit(name)))
    gone = documents.where(F.col("collection") == name).select("hash").distinct().join(rest.select("hash"), "hash", "left_anti")
    return {
        "documents": rest, "content": content.join(gone, "hash", "left_anti"), "content_vectors": vectors.join(gone, "hash", "left_anti"),
        "collections": collections.where(F.col("name") != name), "removed": documents.where(F.col("collection") == name).select(filepath(F.col("collection"), F.col("path")).alias("filepath")),
    }


def clear_vectors(vectors: DataFrame, documents: DataFrame | None = None, collection: str | None = None) -> DataFrame:
    """No vectors, or those left after removing the hashes of the collection's active documents."""
    if collection is None:
        return vectors.limit(0)
    mine = active(documents).where(F.col("collection") == collection).select("hash").distinct()
    return vectors.join(mine, "hash", "left_anti")


def outcome_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- vectors


def upsert_vectors(vectors: DataFrame, incoming: DataFrame) -> DataFrame:
    """Vectors in which ``incoming`` replaces rows of equal (hash, seq); of repeated incoming keys the largest vid counts."""
    order = Window.partitionBy("hash", "seq").orderBy(F.desc_nulls_last("vid"))
    one = incoming.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return vectors.join(one.select("hash", "seq"), ["hash", "seq"], "left_anti").unionByName(one, allowMissingColumns=True)


def allocate_vids(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh`` (hash, seq, ...) with vid above every stored one, by (hash, seq)."""
    top = vectors.agg(F.coalesce(F.max("vid"), F.lit(-1)).alias("_top"))
    return with_dense_ids(fresh, ["hash", "seq"], "_n").crossJoin(F.broadcast(top)).withColumn("vid", F.col("_top") + F.col("_n")).drop("_n", "_top")  # one row


def pending_hashes(documents: DataFrame, vectors: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Hashes of active, not blank documents for which no vector is stored under any fingerprint, each once."""
    mine = in_collections(active(documents), names).where(~is_blank(F.col("text")) & F.col("hash").isNotNull())
    return mine.select("hash").distinct().join(vectors.select("hash"), "hash", "left_anti")


def orphan_vectors(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors whose hash no active document has."""
    return vectors.join(active(documents).select("hash"), "hash", "left_anti")


def fingerprints(vectors: DataFrame) -> DataFrame:
    """Rows a fingerprint, most first, then by name; empty ones don't count."""
    return vectors.where(F.col("embed_fingerprint") != "").groupBy("embed_fingerprint").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "embed_fingerprint")


def stale_fingerprints(vectors: DataFrame, expected: str | Column) -> DataFrame:
    """Distinct fingerprints that are neither empty nor the expected one."""
    want = F.lit(expected) if isinstance(expected, str) else expected
    return vectors.where((F.col("embed_fingerprint") != "") & (F.col("embed_fingerprint") != want)).select("embed_fingerprint").distinct()


def embedded(hashes: DataFrame, content: DataFrame, backend, now: str) -> DataFrame:
    """Rows of vectors, without vid, for the chunks of the contents of ``hashes``."""
    pieces = chunks(content.join(hashes, "hash", "left_semi").select("hash", "doc"), "doc").where(~is_blank(F.col("chunk")))
    made = backend.embed_passages(pieces, "chunk", "embedding")
    return made.select("hash", "seq", "pos", F.lit(backend.embed_model).alias("model"), embed_fingerprint(backend.embed_model).alias("embed_fingerprint"), "total_chunks", F.lit(now).alias("embedded_at"), "embedding")


def embed_pending(documents: DataFrame, content: DataFrame, vectors: DataFrame, backend, now: str, names: list[str] | None = None, rebuild: bool = False) -> DataFrame:
    """The vectors after embedding the chunks of everything pending; with ``rebuild`` what is in scope is embedded again.

    One table results. :meth:`cairn.sources.store.Store.embed` does the same in steps that survive a failure.
    """
    if rebuild:
        vectors = vectors.join(in_collections(active(documents), names).select("hash").distinct(), "hash", "left_anti") if names else vectors.limit(0)
    todo = pending_hashes(documents, vectors, names)
    return upsert_vectors(vectors, allocate_vids(vectors, cut(embedded(todo, content, backend, now))))


# ---------------------------------------------------------------- collections, settings, reports


def upsert_collection(collections: DataFrame, row: dict) -> DataFrame:
    """The catalog with the collection ``row`` names, in place of one of that name; fields that ``row`` lacks have their defaults."""
    default = {"pattern": DEFAULT_PATTERN, "include_by_default": True, "allow_hidden": False} | {k: v for k, v in row.items() if v is not None}
    new = collections.sparkSession.createDataFrame([tuple(default.get(f.name) for f in collections.schema)], collections.schema)
    return collections.where(F.col("name") != row["name"]).unionByName(new)


def rename_collection(documents: DataFrame, collections: DataFrame, config: DataFrame, old: str, new: str) -> dict[str, DataFrame]:
    """Documents, catalog and contexts under the new name. ValueError if ``old`` is missing or ``new`` is taken."""
    names = {r[0] for r in collections.where(F.col("name").isin(old, new)).select("name").collect()}  # at most two
    if old not in names or new in names:
        raise ValueError(f"no collection {old}" if old not in names else f"collection {new} exists")
    swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)).alias(c)
    a, b = f"context:doc://{old}/", f"context:doc://{new}/"
    key = F.when(F.startswith(F.col("key"), F.lit(a)), F.concat(F.lit(b), F.substring(F.col("key"), F.lit(len(a) + 1), F.length("key")))).otherwise(F.col("key")).alias("key")
    return {
        "documents": documents.select(*[swap(c) if c == "collection" else F.col(c) for c in documents.columns]),
        "collections": collections.select(*[swap(c) if c == "name" else F.col(c) for c in collections.columns]),
        "config": config.select(*[key if c == "key" else F.col(c) for c in config.columns]),
    }


def set_field(collections: DataFrame, name: str, field: str, value) -> DataFrame:
    """The catalog with one field of one collection changed: the include flag or the update command, which is stored, never run."""
    kind = collections.schema[field].dataType
    return collections.withColumn(field, F.when(F.col("name") == name, F.lit(value).cast(kind)).otherwise(F.col(field)))


def set_config(config: DataFrame, key: str, value: str | None) -> DataFrame:
    rest = config.where(F.col("key") != key)
    return rest.unionByName(config.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def delete_config(config: DataFrame, key: str) -> DataFrame:
    return config.where(F.col("key") != key)


def config_by_prefix(config: DataFrame, prefix: str) -> DataFrame:
    return config.where(F.col("key").startswith(prefix)).orderBy("key")


def collection_stats(documents: DataFrame) -> DataFrame:
    """Active documents and the latest modified_at (as text) of each collection."""
    return active(documents).groupBy("collection").agg(F.count(F.lit(1)).alias("n_documents"), F.max("modified_at").alias("last_modified"))


def status(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: active documents, vectors, hashes pending, and the latest modified_at."""
    a = active(documents).agg(F.count(F.lit(1)).alias("n_documents"), F.max("modified_at").alias("last_modified"))
    b = vectors.agg(F.count(F.lit(1)).alias("n_vectors"))
    c = pending_hashes(documents, vectors).agg(F.count(F.lit(1)).alias("n_pending"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def collection_report(collections: DataFrame, documents: DataFrame, config: DataFrame) -> DataFrame:
    """Every collection with its counts and what it lacks: a context at its root, an update command."""
    stats = collection_stats(documents).withColumnRenamed("collection", "name")
    roots = config.where(F.col("value").isNotNull()).select(F.col("key").alias("_k")).distinct()
    base = collections.join(stats, "name", "left").withColumn("_key", F.concat(F.lit("context:doc://"), F.col("name"), F.lit("/")))
    return base.join(roots, F.col("_key") == F.col("_k"), "left").select(
        "name", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "last_modified", F.coalesce("include_by_default", F.lit(True)).alias("included"),
        F.col("_k").isNull().alias("lacks_context"), (F.coalesce("update_command", F.lit("")) == "").alias("lacks_command"),
    )


def doctor(documents: DataFrame, vectors: DataFrame, collections: DataFrame, expected: str | None) -> DataFrame:
    """Rows (check, severity, value): collections, stale fingerprints, orphaned vectors, hashes pending."""
    count = lambda df, name, bad: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("check"), F.when(F.col("value") > 0, bad[1]).otherwise(bad[0]).alias("severity"), "value")
    checks = [
        count(collections, "collections", ("warning", "ok")), count(stale_fingerprints(vectors, expected or ""), "stale fingerprints", ("ok", "warning")),
        count(orphan_vectors(vectors, documents), "orphaned vectors", ("ok", "warning")), count(pending_hashes(documents, vectors), "pending hashes", ("ok", "note")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def with_hash(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("hash", content_hash(F.col(text)))
