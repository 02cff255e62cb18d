"""Exact cosine search of a batch of query vectors over all stored vectors, and document-to-document similarity.

Each task multiplies its vectors with a query matrix, keeps the best groups (vectors or documents) of every query, and only those
are exchanged. Up to ``BLOCK`` query vectors are broadcast; larger sets meet the vectors block by block in tasks of their own, equal
vectors and keys that ask with the same vectors once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.scalars import filepath
from cairn.operators.filters import active
from cairn.plans.lineage import cut
from cairn.schemas import SIMILAR_CHUNKS

BLOCK, PART = 8192, 65_536
#: Blocks that meet parts are so many times as large as what is broadcast: each vector is exchanged once a block.
WIDER = 4
#: Keys and vectors multiplied at a time. Bounds memory; has no influence on results.
QUERIES, VECTORS = 512, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def normalized(v: Column) -> Column:
    """``v`` with length one; a zero vector stays zero."""
    return F.transform(v, lambda x: (x / F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))).cast("float"))


def usable(vectors: DataFrame, embedding: str = "embedding", dim: int | None = None) -> DataFrame:
    """Vectors without nulls, NaN or infinities, not all zero, and of ``dim`` numbers if that is given."""
    x = F.col(embedding)
    ok = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(ok & (F.size(x) == dim) if dim else ok)


def by_vid(vectors: DataFrame, vids: list[int]) -> DataFrame:
    """The vectors of ``vids``. KeyError if one is missing."""
    found = vectors.where(F.col("vid").isin(vids))
    have = {r[0] for r in found.select("vid").distinct().collect()}  # at most the vids asked for
    if missing := sorted(set(vids) - have):
        raise KeyError(f"no vector with vid {missing}")
    return found


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where, in sorted columns, rows begin that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _place(starts: np.ndarray, n: int) -> np.ndarray:
    """The place from 0 of each of ``n`` rows in its run."""
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


class _Block:
    """Query vectors grouped by their key; finds each key's best groups among some vectors."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, not_own: bool, margin: float):
        order = np.argsort(ids, kind="stable")
        ids, self.matrix, self.k, self.not_own, self.margin = ids[order], matrix[order], k, not_own, margin
        self.starts = _runs(ids)
        self.keys = ids[self.starts]

    def best(self, group: pa.Array, x: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """(keys, groups, scores): all groups that may be among the k best of a key after rounding; of groups with one score the k smallest."""
        kind = group.type
        groups, codes = np.unique(np.array(group.to_pylist(), dtype=object if pa.types.is_string(kind) else None), return_inverse=True)
        if not len(groups) or not len(self.keys):
            return
        order = np.argsort(codes, kind="stable")
        codes, x = codes[order], x[order]
        for at in range(0, len(self.starts), QUERIES):
            some, keys = self.starts[at : at + QUERIES], self.keys[at : at + QUERIES]
            asked = self.matrix[some[0] : self.starts[at + QUERIES] if at + QUERIES < len(self.starts) else len(self.matrix)]
            of = np.repeat(np.arange(len(some)), np.diff(np.append(some, some[0] + len(asked))))  # the key of each row
            bar, found = np.full(len(keys), -2.0), []  # of every key, k groups are known that reach its bar
            for lo in range(0, len(x), VECTORS):
                held, rows = codes[lo : lo + VECTORS], of
                cos = asked @ x[lo : lo + VECTORS].T
                near = cos >= (bar - self.margin)[rows, None]
                if np.count_nonzero(near) > self.k * len(cos):  # the bars are low
                    firsts = _runs(held)
                    held, rows = held[firsts], np.arange(len(keys))
                    cos = np.maximum.reduceat(np.maximum.reduceat(cos, some - some[0], axis=0), firsts, axis=1)  # a key may have several vectors, and a group too
                    if self.not_own:
                        cos[keys[:, None] == groups[held][None, :]] = -np.inf
                    if len(held) >= self.k:
                        bar = np.maximum(bar, np.partition(cos, len(held) - self.k, axis=1)[:, len(held) - self.k])
                    near = cos >= (bar - self.margin)[:, None]
                r, c = np.nonzero(near)
                found.append((rows[r], held[c], cos[r, c]))
            r, c, score = (np.concatenate(f) for f in zip(*found))
            if self.not_own:
                other = np.asarray(keys[r] != groups[c], bool)
                r, c, score = r[other], c[other], score[other]
            r, c, score = self._pruned(r, c, score)
            yield keys[r], pa.array(groups[c].tolist(), kind), score

    def _pruned(self, r: np.ndarray, c: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((-score, c, r))
        order = order[_runs(r[order], c[order])]  # the best of a key and a group
        order = order[np.lexsort((c[order], -score[order], r[order]))]
        r, c, score = r[order], c[order], score[order]
        keys = _runs(r)
        ends = np.append(keys[1:], len(r))
        bar = np.repeat(score[np.minimum(keys + self.k, ends) - 1], ends - keys)
        keep = (score >= bar - self.margin) & (_place(_runs(r, score), len(r)) < self.k)
        return r[keep], c[keep], score[keep]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches in tables of ``rows`` rows and up to one batch more."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if n:
        yield pa.Table.from_batches(some)


def _broadcast_search(mine: DataFrame, table: pa.Table, names: list[str], schema: T.StructType, k: int, dim: int, not_own: bool, margin: float, part: int) -> DataFrame:
    block = _block(table, k, dim, not_own, margin)
    shipped = mine.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, part):
            for keys, groups, scores in shipped.value.best(held.column(0).combine_chunks(), _unit(held.column(1).combine_chunks(), dim)):
                yield pa.RecordBatch.from_arrays([pa.array(keys), groups, pa.array(scores)], names=names)

    return mine.mapInArrow(run, schema)


def _block(asked: pa.Table, k: int, dim: int, not_own: bool, margin: float) -> _Block:
    matrix = _unit(asked.column(1).combine_chunks(), dim) if asked.num_rows else np.empty((0, dim))
    return _Block(asked.column(0).to_numpy(), matrix, k, not_own, margin)


def _blocked_search(mine: DataFrame, asked: DataFrame, names: list[str], schema: T.StructType, k: int, dim: int, not_own: bool, margin: float, blocks: int, parts: int) -> DataFrame:
    """Every block of queries meets every part of the vectors in a task of its own; nothing goes through the driver."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # a name of its own: where both sides come from one table, Spark finds a column that they share ambiguous
    left = asked.withColumnRenamed("embedding", "_asked").withColumn("_b", F.pmod(F.xxhash64(names[0]), F.lit(blocks)).cast("int")).withColumn("_p", each(parts))
    right = mine.withColumn("_p", F.pmod(F.xxhash64(names[1], "embedding"), F.lit(parts)).cast("int")).withColumn("_b", each(blocks))

    def meet(queries: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and held.num_rows:
            block = _block(queries, k, dim, not_own, margin)
            found = [pa.table([pa.array(q), g, pa.array(s)], names=names) for q, g, s in block.best(held.column(0).combine_chunks(), _unit(held.column(1).combine_chunks(), dim))]
        kind = held.schema.field(0).type
        return pa.concat_tables(found) if found else pa.table([pa.array([], pa.int64()), pa.array([], kind), pa.array([], pa.float64())], names=names)

    return left.groupBy("_b", "_p").cogroup(right.groupBy("_b", "_p")).applyInArrow(meet, schema)


def _first_of_equal(mine: DataFrame, group: str, k: int) -> DataFrame:
    """``mine`` with each vector in its ``k`` smallest groups alone: a group with ``k`` smaller ones at its best vector isn't among the ``k`` best."""
    order = Window.partitionBy("_h", "embedding").orderBy(group)  # sorts by the hash: arrays are slow to compare
    first = mine.withColumn("_h", F.xxhash64("embedding")).withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= k)
    return first.drop("_r").distinct().drop("_h")


def _askers(asked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The vectors of one key of all that have the same vectors; and every key with the ``_asker`` that asks for it."""
    ids = cut(asked.select("embedding").distinct().withColumn("_v", F.monotonically_increasing_id()))  # written once: the ids stay
    sets = cut(asked.join(ids, "embedding").groupBy(key).agg(F.sort_array(F.collect_set("_v")).alias("_set")))
    askers = cut(sets.join(sets.groupBy("_set").agg(F.min(key).alias("_asker")), "_set").select(key, "_asker"))
    return asked.join(askers.where(F.col(key) == F.col("_asker")).select(key), key, "left_semi").distinct(), askers


def nearest(vectors: DataFrame, queries: DataFrame, k: int, group: str = "vid", key: str = "query_id", dim: int = 64, digits: int = 6, not_own: bool = False, block: int = BLOCK, part: int = PART) -> DataFrame:
    """key, group, score and rank: of each query the ``k`` groups with the highest cosine of any pair of their vectors.

    ``vectors`` has group and embedding, ``queries`` has key and embedding, several rows a key if it has several vectors. Scores
    are rounded to ``digits``, ties go to the smaller group. Unusable vectors and null keys or groups take no part; ``not_own``
    leaves out the group equal to the key. Empty inputs give no rows. Up to ``block`` query vectors are broadcast; more meet the
    vectors in blocks of ``WIDER`` times so many, each with ``part`` vectors.
    """
    asked = usable(queries, dim=dim).where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), "embedding")
    mine = usable(vectors, dim=dim).where(F.col(group).isNotNull()).select(group, "embedding")
    names = [key, group, "score"]
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(group, mine.schema[group].dataType), T.StructField("score", T.DoubleType())])
    margin = 10.0**-digits  # scores that round to one value differ by less
    order = Window.partitionBy(key).orderBy(F.desc("score"), group)

    def best(found: DataFrame) -> DataFrame:
        most = found.groupBy(key, group).agg(F.round(F.max("score"), digits).alias("score"))
        return most.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)

    few = asked.limit(block + 1).toArrow()
    if few.num_rows <= block:
        return best(_broadcast_search(mine, few, names, schema, k, dim, not_own, margin, part))
    # both are counted and exchanged: what made them runs once
    asked, mine = cut(asked), cut(_first_of_equal(mine, group, k + not_own))
    askers = None
    if not not_own:  # else what a key leaves out is its own
        asked, askers = _askers(asked, key)
        asked = cut(asked)
    n, blocks = mine.count(), -(-asked.count() // (WIDER * block))
    busy = -(-2 * mine.sparkSession.sparkContext.defaultParallelism // blocks)
    parts = max(-(-n // part), min(-(-n // BLOCK), busy), 1)  # smaller parts than asked for where cores would wait
    found = best(_blocked_search(mine, asked, names, schema, k, dim, not_own, margin, blocks, parts))
    return found.withColumnRenamed(key, "_asker").join(askers, "_asker").select(key, group, "score", "rank") if askers else found


def nearest_documents(vectors: DataFrame, documents: DataFrame, queries: DataFrame, k: int, key: str, dim: int, block: int = BLOCK, part: int = PART) -> DataFrame:
    """key, filepath and score of documents among which are the ``k`` best active ones of each query, ties going to the smaller filepath.

    Contents are searched, each once however many documents share it, under names that sort as the smallest filepaths of their
    documents: before any document of a content that isn't among the ``k`` best come ``k`` others. The best are then given their
    documents, of which the first ``k`` by filepath can count.
    """
    places = active(documents).select("hash", filepath(F.col("collection"), F.col("path")).alias("filepath")).where(F.col("hash").isNotNull())
    order = Window.partitionBy("hash").orderBy("filepath")
    first = places.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= k).distinct()
    named = first.where(F.col("_r") == 1).select("hash", F.concat(F.coalesce("filepath", F.lit("")), F.lit("\0"), "hash").alias("_name"))
    mine = vectors.select("hash", "embedding").join(named, "hash").select("_name", "embedding")
    found = nearest(mine, queries, k, "_name", key, dim, block=block, part=part).withColumn("hash", F.substring_index("_name", "\0", -1))
    return found.join(first, "hash").select(key, "filepath", "score")


def vsearch(vectors: DataFrame, documents: DataFrame, queries: DataFrame, limit: int, key: str = "query_id", dim: int = 64, block: int = BLOCK, part: int = PART) -> DataFrame:
    """key, filepath, score and rank: the ``limit`` documents in scope (``documents``) whose best chunk is most like the query."""
    found = nearest_documents(vectors, documents, queries, limit, key, dim, block, part)
    order = Window.partitionBy(key).orderBy(F.desc("score"), "filepath")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit)


def source_chunks(vectors: DataFrame, most: int = SIMILAR_CHUNKS) -> DataFrame:
    """The first ``most`` vectors of each hash by (seq, vid)."""
    order = Window.partitionBy("hash").orderBy("seq", "vid")
    return vectors.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def similar(vectors: DataFrame, documents: DataFrame, sources: DataFrame, limit: int, dim: int = 64, block: int = BLOCK, part: int = PART) -> DataFrame:
    """doc_id (of ``sources``), filepath, score and rank: the documents most like each source by any of its first chunks.

    The source itself is left out by its filepath; a copy elsewhere is not. Sources without vectors give no rows.
    """
    mine = sources.select("doc_id", "hash", filepath(F.col("collection"), F.col("path")).alias("_own"))
    queries = source_chunks(vectors.join(mine.select("hash").distinct(), "hash", "left_semi")).join(mine, "hash").select("doc_id", "embedding")
    found = nearest_documents(vectors, documents, queries, limit + 1, "doc_id", dim, block, part)
    rest = found.join(mine.select("doc_id", "_own"), "doc_id").where(F.col("filepath") != F.col("_own"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "filepath")
    return rest.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit).select("doc_id", "filepath", "score", "rank")


def hit_documents(hits: DataFrame, vectors: DataFrame, documents: DataFrame, key: str = "query_id") -> DataFrame:
    """Vector hits (key, vid, score) with the document each belongs to: of several with the hash the smallest doc_id in ``documents``."""
    one = active(documents).groupBy("hash").agg(F.min(F.struct("doc_id", filepath(F.col("collection"), F.col("path")).alias("filepath"), "title")).alias("_d"))
    places = vectors.select("vid", "hash", "seq", "pos").distinct()
    return hits.join(places, "vid").join(one, "hash").select(key, "vid", "score", "hash", "seq", "pos", "_d.*")
