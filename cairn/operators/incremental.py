"""Processing only new or changed records, with the target itself as the state.

Nothing is remembered about past runs beside what they published: every output row carries its source key and version, a run
takes the source rows that the current target lacks (an anti join), and a new target version becomes visible in one atomic
step. A run that dies before that step leaves the old version; its work is neither skipped nor repeated into the target.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.text import is_blank
from cairn.plans.lineage import cut


def pending(source: DataFrame, done: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Rows of ``source`` whose (key, version) is not in ``done``.

    * null keys and versions compare as equal to each other (``<=>``), so a row with a null version is taken once;
    * repeated rows of ``done`` don't matter; repeated rows of ``source`` are all returned;
    * an empty ``done`` returns the source, an empty source returns nothing; extra columns are kept and may clash.
    """
    names = [*key, *([version] if version else [])]
    have = done.select(*[F.col(c).alias(f"_done_{i}") for i, c in enumerate(names)]).distinct()
    on = None
    for i, c in enumerate(names):
        same = source[c].eqNullSafe(have[f"_done_{i}"])
        on = same if on is None else on & same
    return source.join(have, on, "left_anti")


def complete_hashes(vectors: DataFrame, fingerprint: str | None) -> DataFrame:
    """Hashes that hold every seq from 0 to total_chunks-1 under ``fingerprint`` with a vid; the largest total_chunks counts.

    Rows written twice count once. Rows with null hash, seq, total_chunks or vid don't count; a null fingerprint completes
    nothing. A hash's rows are reduced to distinct seqs before the exchange, so a hot hash is no hot task.
    """
    kept = vectors.where(F.col("hash").isNotNull() & (F.col("embed_fingerprint") == F.lit(fingerprint)) & F.col("vid").isNotNull() & (F.col("seq") >= 0))
    seqs = kept.groupBy("hash", "seq").agg(F.max("total_chunks").alias("total"))
    per_hash = seqs.groupBy("hash").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("n"), F.max("seq").alias("top"), F.count(F.when(F.col("seq") >= F.col("total"), True)).alias("over"))
    # every seq is distinct and not negative, so n - over of them lie below the total
    exact = per_hash.where(F.col("total") > 0).where(F.when(F.col("top") < F.col("total"), F.col("n") >= F.col("total")).otherwise(F.col("n") - F.col("over") >= F.col("total")))
    return exact.select("hash")


def pending_documents(documents: DataFrame, vectors: DataFrame, fingerprint: str | None) -> DataFrame:
    """Documents that an embedding run must take up now, whatever their times say and however earlier runs ended.

    A document counts if ``active`` isn't false (null counts as true) and its text has a visible character; it is pending
    unless its hash is complete in the target. A null hash is pending. An empty target makes all such documents pending.
    """
    live = documents.where(F.coalesce(F.col("active"), F.lit(True)) & ~is_blank(F.col("text")))
    return pending(live, complete_hashes(vectors, fingerprint), ["hash"])


#: File systems on which a rename refuses a name that exists, in one step.
_RENAMING = ("hdfs", "viewfs", "ofs", "o3fs", "abfs", "abfss")
#: Folders without a marker are left alone for so many seconds, for the run that may still be writing them.
LEASE = 24 * 3600


class VersionedTarget:
    """A table published version by version. ``<path>/_published/<n>`` is the manifest of version n: the folders it consists of.

    A version is a list of parts, each with a folder of rows, a folder of removed keys, or both: a part removes what earlier parts hold
    of these keys and adds its rows. So publishing a change writes the change alone; :meth:`compact` makes one part of them all.

    A version is visible once its manifest exists, which comes about complete and in one step: by a hard link on local disks, elsewhere
    by a rename, on file systems where a rename refuses an existing name (others are refused with an error). Of two runs that publish
    the same number one fails and nothing is mixed. Folders of no manifest are leftovers of failed runs: never read, and removed by
    :meth:`vacuum` once they are older than the lease.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str] | None = None, partition_by: list[str] | None = None, schema: T.StructType | None = None, sort_by: list[str] | None = None):
        """``partition_by`` lays rows out in folders, sorted by ``sort_by``; ``schema`` holds also for parts without a row."""
        self.spark, self.path, self.key = spark, path.rstrip("/"), key or []
        self.partition_by, self.sort_by, self.schema = partition_by or [], sort_by or [], schema
        self._jvm = spark.sparkContext._jvm
        self._at = lambda *p: self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *p]))
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the published versions; nothing but names is read."""
        if not self._fs.exists(self._at("_published")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("_published"))]
        return sorted(int(x) for x in names if re.fullmatch(r"\d+", x))

    def manifest(self, n: int) -> list[dict]:
        """The parts of version ``n``: rows and gone, names of folders or None."""
        stream = self._fs.open(self._at("_published", str(n)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]
        finally:
            stream.close()

    def _read(self, folders: list[str]) -> DataFrame:
        reader = lambda f: self.spark.read.schema(self.schema) if self.schema is not None and "-gone-" not in f else self.spark.read
        frames = [reader(f).parquet(f"{self.path}/{f}") for f in folders]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def current(self, where: Column | None = None) -> DataFrame | None:
        """The rows of the newest published version, or None. ``where`` narrows what is read of every folder."""
        found = self.versions()
        if not found:
            return None
        parts = self.manifest(found[-1])
        narrow = lambda d: d if where is None else d.where(where)
        gone = [(i, p["gone"]) for i, p in enumerate(parts) if p["gone"]]
        if not gone:
            return narrow(self._read([p["rows"] for p in parts if p["rows"]]))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [narrow(self._read([p["rows"]])).withColumn("_part", F.lit(i)) for i, p in enumerate(parts) if p["rows"]])
        removed = reduce(DataFrame.unionByName, [self._read([f]).select(*[F.col(c).alias(f"_gone_{c}") for c in self.key], F.lit(i).alias("_by")) for i, f in gone])
        last = removed.groupBy(*[f"_gone_{c}" for c in self.key]).agg(F.max("_by").alias("_by"))
        same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(last[f"_gone_{c}"]) for c in self.key])
        return rows.join(last, same & (rows["_part"] < last["_by"]), "left_anti").drop("_part")

    def _write(self, rows: DataFrame, name: str) -> str:
        folder = f"v-{name}-{uuid.uuid4().hex[:12]}"
        if self.partition_by and set(self.partition_by) <= set(rows.columns):
            kept = [c for c in rows.columns if self.schema is None or c in self.schema.names]
            rows.sortWithinPartitions(*self.partition_by, *self.sort_by).select(*kept).write.partitionBy(*self.partition_by).parquet(f"{self.path}/{folder}")
        else:
            rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _announce(self, n: int, parts: list[dict]) -> None:
        unseen, marker = self._at(f"_new-{uuid.uuid4().hex}"), self._at("_published", str(n))
        out = self._fs.create(unseen, False)
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        self._fs.mkdirs(self._at("_published"))
        scheme = self._fs.getUri().getScheme()
        if scheme == "file":
            files, plain = self._jvm.java.nio.file.Files, lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                files.createLink(plain(marker), plain(unseen))
                done = True
            except Exception:  # the name exists
                done = False
        elif scheme in _RENAMING:
            done = not self._fs.exists(marker) and self._fs.rename(unseen, marker)
        else:
            raise NotImplementedError(f"{scheme}: no step that creates a file once and whole; put the table on one of file, {', '.join(_RENAMING)}")
        self._fs.delete(unseen, False)
        if not done:
            raise RuntimeError(f"version {n} was published by another run")
        lost = [f for p in parts for f in p.values() if f and not self._fs.exists(self._at(f))]
        if lost:
            self._fs.delete(marker, False)
            raise RuntimeError(f"version {n} lost its folders {lost} before it was published")

    def _publish(self, before: list[dict], rows: DataFrame | None, gone: DataFrame | None, n: int) -> int:
        part = {"rows": None, "gone": None}
        try:
            part["rows"] = None if rows is None else self._write(rows, f"{n}")
            part["gone"] = None if gone is None else self._write(gone.select(*self.key).distinct(), f"{n}-gone")
            self._announce(n, [*before, part])
        except Exception:
            for f in filter(None, part.values()):
                self._fs.delete(self._at(f), True)
            raise
        return n

    def publish(self, rows: DataFrame) -> int:
        """A version of ``rows`` alone."""
        return self._publish([], rows, None, max(self.versions(), default=0) + 1)

    def publish_change(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """The newest version without the keys of ``gone`` and with ``rows`` added. Only these are written."""
        if gone is not None and not self.key:
            raise ValueError("a table without a key can't lose rows")
        found = self.versions()
        return self._publish(self.manifest(found[-1]) if found else [], rows, gone, max(found, default=0) + 1)

    def compact(self) -> int | None:
        """A version with the same rows in one part; None if there is one part or none."""
        found = self.versions()
        if not found or len(self.manifest(found[-1])) < 2:
            return None
        return self._publish([], self.current(), None, found[-1] + 1)

    def vacuum(self, keep: int = 2, lease: float = LEASE) -> list[str]:
        """Remove all but the newest ``keep`` versions, and folders of no manifest that are older than ``lease`` seconds."""
        found = self.versions()
        for n in found[:-keep]:
            self._fs.delete(self._at("_published", str(n)), False)
        held = {f for n in found[-keep:] for p in self.manifest(n) for f in p.values() if f}
        gone = []
        for s in self._fs.listStatus(self._at()):
            name = s.getPath().getName()
            if name.startswith(("v-", "_new-")) and name not in held and s.getModificationTime() < (time.time() - lease) * 1000:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def run(self, source: DataFrame, key: list[str], version: str, work: Callable[[DataFrame], DataFrame]) -> int | None:
        """Process the source rows whose (key, version) the target lacks and publish the change; None if nothing is new.

        ``work`` must keep the columns of ``key`` and ``version``. Rows of a key with another version are replaced; keys that
        are no longer in the source stay. What is written is in proportion to what is new.
        """
        self.key = self.key or key
        now = self.current()
        fresh = source if now is None else pending(source, now, key, version)
        keys = cut(fresh.select(*key).distinct())
        if keys.isEmpty():
            return None
        made = work(fresh)
        if now is None:
            return self.publish(made)
        had = cut(pending(keys, pending(keys, now, key), key))  # keys that the target holds
        return self.publish_change(made, None if had.isEmpty() else had)
