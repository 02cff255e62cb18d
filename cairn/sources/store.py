"""The index on disk: a folder with one versioned table each for content, documents, vectors, postings, collections and settings."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.scalars import filepath
from cairn.operators import catalog
from cairn.operators.fulltext import StoredIndex
from cairn.operators.incremental import VersionedTarget
from cairn.plans.lineage import cut
from cairn.schemas import KEYS, TABLES
from cairn.sources.files import read_collection

LOCAL_DIR = ".cairn"
#: Contents embedded between two publications.
EMBED_BATCH = 100_000


def index_dir(given: str | None = None, cwd: str | None = None, home: str | None = None) -> str:
    """The folder given, else the project's own if it holds an index, else the user's cache."""
    if given:
        return given
    local = os.path.join(cwd or os.getcwd(), LOCAL_DIR)
    return local if os.path.isdir(os.path.join(local, "documents")) else os.path.join(home or os.path.expanduser("~"), ".cache", "cairn")


def now_text() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class Store:
    """Reads the newest version of each table and publishes new ones. ``read_only`` makes every change a PermissionError.

    A table that was never written is empty. Stored tables may lack columns that were added later; these are null. Changes are
    published as changes: what is written is in proportion to what is new. :meth:`compact` merges them when there are many.
    """

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        #: The keyword index over the active documents; every change of documents refreshes it.
        self.index = StoredIndex(spark, f"{self.path}/postings")

    def _target(self, name: str) -> VersionedTarget:
        return VersionedTarget(self.spark, f"{self.path}/{name}", KEYS[name])

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError(f"{self.path} is open for reading only")

    def table(self, name: str) -> DataFrame:
        have = self._target(name).current()
        if have is None:
            return self.spark.createDataFrame([], TABLES[name])
        missing = [f for f in TABLES[name] if f.name not in have.columns]
        return have.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])

    def publish(self, name: str, rows: DataFrame) -> int:
        self._writable()
        return self._target(name).publish(rows)

    def change(self, name: str, rows: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Publish ``rows`` in place of those with the keys of ``gone``."""
        self._writable()
        return self._target(name).publish_change(rows, gone)

    def compact(self) -> None:
        """Merge the parts of every table, and of the index, into one each."""
        self._writable()
        for name in TABLES:
            self._target(name).compact()
        self.index.target.compact()

    def refresh_index(self) -> int | None:
        """Bring the keyword index to the state of the documents. A failure between both is mended by the next refresh."""
        self._writable()
        return self.index.refresh(self.table("documents"))

    def take_in(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Upsert documents (collection, path, title, hash, text, raw) and set those of ``gone`` (doc_id) inactive.

        Content is published before the documents that refer to it; each table changes in one step.
        """
        self._writable()
        documents, now = self.table("documents"), now_text()
        fresh = cut(catalog.new_content(self.table("content"), rows.select("hash", F.col("raw").alias("doc"), F.lit(now).alias("created_at"))))
        change = catalog.document_change(documents, rows, now)
        if gone is not None:
            off = documents.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("active", F.lit(False))
            change = change.unionByName(off.select(*documents.columns))
        change = cut(change)
        if not fresh.isEmpty():
            self.change("content", fresh)
        if not change.isEmpty():
            self.change("documents", change, change.select("doc_id"))
            self.refresh_index()

    def update(self, name: str) -> DataFrame:
        """Take in a collection's files. One row: new, updated, reactivated, unchanged, removed and skipped.

        A stored update command is never run. Vectors are left alone: :meth:`embed` sees what is missing.
        """
        row = self.table("collections").where(F.col("name") == name).first()
        if row is None:
            raise ValueError(f"no collection {name}")
        files = cut(read_collection(self.spark, name, row.path, row.pattern, row.ignore, bool(row.allow_hidden)))
        walked, good = files.select("collection", "path"), files.where(F.col("skip_reason").isNull())
        documents = self.table("documents")
        outcome = cut(catalog.outcome_counts(catalog.classify(documents, good)))
        gone = cut(catalog.missing_documents(documents, walked, name))
        self.take_in(good, gone)
        counts = [F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0)).alias(o) for o in ("new", "updated", "reactivated", "unchanged")]
        removed = gone.agg(F.count(F.lit(1)).alias("removed"))
        skipped = files.agg(F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"))
        return outcome.agg(*counts).crossJoin(removed).crossJoin(skipped).select(F.lit(name).alias("collection"), "*")  # one row each

    def add_collection(self, name: str, root: str, **fields) -> DataFrame:
        """Add a collection, or set an existing one up anew, and take in its files."""
        self.publish("collections", catalog.upsert_collection(self.table("collections"), {"name": name, "path": root, **fields}))
        return self.update(name)

    def remove_collection(self, name: str) -> DataFrame:
        """Purge a collection; returns the filepaths removed."""
        if self.table("collections").where(F.col("name") == name).isEmpty():
            raise ValueError(f"no collection {name}")
        documents, vectors = self.table("documents"), self.table("content_vectors")
        mine = documents.where(F.col("collection") == name)
        removed = cut(mine.select("doc_id", "hash", filepath(F.col("collection"), F.col("path")).alias("filepath")))
        hashes = cut(removed.select("hash").distinct().join(documents.where(~F.col("collection").eqNullSafe(F.lit(name))).select("hash"), "hash", "left_anti"))
        pieces = cut(vectors.join(hashes, "hash", "left_semi").select("hash", "seq"))
        self.publish("collections", self.table("collections").where(F.col("name") != name))
        for table, gone in (("documents", removed.select("doc_id")), ("content_vectors", pieces), ("content", hashes)):
            if not gone.isEmpty():
                self.change(table, gone=gone)
        self.refresh_index()
        return removed.select("filepath")

    def rename_collection(self, old: str, new: str) -> None:
        made = catalog.rename_collection(self.table("documents"), self.table("collections"), self.table("config"), old, new)
        moved = cut(made["documents"].where(F.col("collection") == new))
        self.publish("config", made["config"])
        if not moved.isEmpty():
            self.change("documents", moved, moved.select("doc_id"))
        self.publish("collections", made["collections"])
        self.refresh_index()

    def embed(self, backend, names: list[str] | None = None, rebuild: bool = False, batch: int = EMBED_BATCH) -> int:
        """Embed what is pending, ``batch`` contents at a time; the number of contents embedded.

        Each batch is published when it is done, so a run that dies has kept those before, and the next run finds what is left. A batch
        of ``rebuild`` replaces the vectors of its contents.
        """
        self._writable()
        documents, vectors = self.table("documents"), self.table("content_vectors")
        if rebuild:
            todo = catalog.pending_hashes(documents, vectors.limit(0), names)
        else:
            todo = catalog.pending_hashes(documents, vectors, names)
        todo = cut(todo)
        n = todo.count()
        steps = -(-n // batch)
        for i in range(steps):
            hashes = todo.where(F.pmod(F.xxhash64("hash", F.lit("step")), F.lit(steps)) == i)
            rows = cut(catalog.embedded(hashes, self.table("content"), backend, now_text()))
            stored = self.table("content_vectors")
            gone = cut(stored.join(hashes, "hash", "left_semi").select("hash", "seq")) if rebuild else None
            self.change("content_vectors", catalog.allocate_vids(stored, rows), gone if gone is not None and not gone.isEmpty() else None)
        return n
