"""The engine's front: search, lookup and status over one store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.backends import NoBackend
from cairn.functions.chunking import chunks
from cairn.functions.scalars import collection_of, docid, file_uri, path_of
from cairn.operators import catalog, filters, fulltext, vectors
from cairn.operators.context import PREFIX as CONTEXT_PREFIX
from cairn.operators.context import context_key, lacking_context, with_context
from cairn.operators.hybrid import hybrid_search
from cairn.sources.files import total_size
from cairn.sources.store import Store

class Engine:
    """Batched retrieval. ``queries`` are (query_id, text) rows; ``collections`` None means the default scope."""

    def __init__(self, store: Store, backend=None):
        self.store, self.backend = store, backend or NoBackend()

    def _scope(self, names: list[str] | None) -> DataFrame:
        return filters.default_scope(filters.active(self.store.table("documents")), self.store.table("collections"), names)

    def _index(self) -> fulltext.StoredIndex | None:
        """The stored index; without one, in a store of tables published by hand, texts are read."""
        return self.store.index if self.store.index.exists() else None

    def _finished(self, found: DataFrame) -> DataFrame:
        """Search hits with address, first chunk and context."""
        texts = self.store.table("content").select("hash", F.col("doc").alias("body"))
        whole = found.join(texts, "hash", "left").withColumn("body", F.coalesce("body", F.lit("")))
        first = chunks(whole.select("query_id", "filepath", "body"), "body").where("seq = 0").select("query_id", "filepath", F.col("chunk").alias("best_chunk"))
        rows = whole.join(first, ["query_id", "filepath"]).select(
            "query_id", F.col("rank").alias("position"), "score", docid(F.col("hash")).alias("docid"), file_uri(F.col("filepath")).alias("file"), "filepath", "title",
            collection_of(F.col("filepath")).alias("collection"), path_of(F.col("filepath")).alias("path"), "body", "best_chunk", F.lit(0).cast("bigint").alias("best_chunk_pos"),
        )
        return with_context(rows, self.store.table("config"), ["query_id", "position"])

    def search(self, queries: list[tuple[int, str]], limit: int = 10, collections: list[str] | None = None) -> DataFrame:
        asked = self.store.spark.createDataFrame(queries, "query_id bigint, query string")
        return self._finished(fulltext.search(self.store.table("documents"), asked, limit, self._scope(collections), index=self._index()))

    def vsearch(self, queries: list[tuple[int, str]], limit: int = 10, collections: list[str] | None = None) -> DataFrame:
        asked = self.backend.embed_queries(self.store.spark.createDataFrame(queries, "query_id bigint, query string"), "query", "embedding")
        scope = self._scope(collections)
        hits = vectors.vsearch(self.store.table("content_vectors"), scope, asked.select("query_id", "embedding"), limit, dim=self.backend.dim)
        about = scope.select(F.concat("collection", F.lit("/"), "path").alias("filepath"), "title", "hash")
        return self._finished(hits.join(about, "filepath"))

    def query(self, queries: list[tuple[int, str]], limit: int = 10, collections: list[str] | None = None, **options) -> DataFrame:
        found = hybrid_search(queries, self.store.table("documents"), self.store.table("content"), self.store.table("content_vectors"), self.backend, limit, self._scope(collections), index=self._index(), **options)
        return with_context(found, self.store.table("config"), ["query_id", "position"])

    def similar(self, spec: str, limit: int = 10) -> DataFrame:
        """Documents like the one that ``spec`` (content id or collection/path) names. LookupError without vectors."""
        stored = self.store.table("content_vectors")
        source = self._one(spec)
        if stored.join(source.select("hash"), "hash", "left_semi").isEmpty():
            raise LookupError(f"no vectors for {spec}")
        return vectors.similar(stored, self.store.table("documents"), source, limit, dim=self.backend.dim)

    def _one(self, spec: str) -> DataFrame:
        at = filters.parse_spec(spec)
        documents = self.store.table("documents")
        found = filters.by_docid(documents, [at["docid"]]).drop("docid") if at["docid"] else filters.at_filepath(documents, at["collection"], at["path"])
        if found.isEmpty():
            raise LookupError(f"no document {spec}")
        return found

    def get(self, spec: str, first: int | None = None, count: int | None = None) -> DataFrame:
        """One document with its numbered lines; a range in ``spec`` yields to explicit arguments."""
        at = filters.parse_spec(spec)
        whole = filters.with_body(self._one(spec), self.store.table("content"))
        return whole.withColumn("lines", filters.numbered_lines(F.col("body"), first or at["from"] or 1, count or at["count"]))

    def multi_get(self, request: str, collections: list[str] | None = None, max_lines: int | None = None, most: int | None = None) -> DataFrame:
        """The documents that ``request`` names with their numbered lines, all or the first ``most``, and their total."""
        found = filters.capped(filters.multi_get(self.store.table("documents"), request, collections), most, ["collection", "path"])
        whole = filters.with_body(found, self.store.table("content"))
        return whole.withColumn("lines", filters.numbered_lines(F.col("body"), 1, max_lines))

    def status(self) -> DataFrame:
        """One row: documents, vectors, hashes pending, the latest change, collections, indexed fields, files and bytes of the store."""
        base = catalog.status(self.store.table("documents"), self.store.table("content_vectors"))
        named = self.store.table("collections").agg(F.count(F.lit(1)).alias("n_collections"))
        index = self._index()
        fields = index.lengths().agg(F.count_distinct("doc_id").alias("n_indexed")) if index else self.store.spark.range(1).select(F.lit(0).cast("bigint").alias("n_indexed"))
        return base.crossJoin(named).crossJoin(fields).crossJoin(total_size(self.store.spark, self.store.path))  # one row each

    def _context_key(self, place: str) -> str:
        known = self.store.table("collections").where(F.col("name") == place).select("name").limit(1).collect()
        return context_key(place, {r.name for r in known})

    def set_context(self, place: str, text: str) -> None:
        """Describe ``/``, a URI below a collection, or a collection by name. ValueError for other places."""
        self.store.publish("config", catalog.set_config(self.store.table("config"), self._context_key(place), text))

    def remove_context(self, place: str) -> None:
        self.store.publish("config", catalog.delete_config(self.store.table("config"), self._context_key(place)))

    def contexts(self) -> DataFrame:
        """place and text of every description, by place."""
        rows = catalog.config_by_prefix(self.store.table("config"), CONTEXT_PREFIX)
        return rows.select(F.substring("key", F.lit(len(CONTEXT_PREFIX) + 1), F.length("key")).alias("place"), F.col("value").alias("text"))

    def lacking_context(self) -> DataFrame:
        return lacking_context(self.store.table("collections"), self.store.table("config"))

    def collections(self) -> DataFrame:
        return catalog.collection_report(self.store.table("collections"), self.store.table("documents"), self.store.table("config"))
