"""Near-duplicate texts: one-permutation hashing, banded buckets and star-shaped candidate edges.

* A text becomes the set of its runs of ``shingle`` words. Texts with equal sets form a class, named by a 64-bit hash of the set
  (of n classes about n^2 / 2^65 pairs could share a name); all later work is on classes, copies are never paired.
* Each of ``HASHES`` hash functions deals the set to ``BINS`` bins and keeps the least value of each; an empty bin takes the
  value of a full one that a fixed random sequence names (optimal densification). Few bins a function keep small sets dense.
* ``ROWS`` values form a band. In a bucket of equal bands the member of least random priority is the centre, and the only edges
  are those from the centre. Pairs of two leaves follow from the edges: if A is like the centre, B can be like A only if B is
  not far from the centre (Jaccard distance is a metric), so leaves near the centre are met over it. Leaves unlike their centre
  stay in the bucket for another round with another centre; buckets of at most ``SMALL`` members are settled by pairs.
* Candidates are thinned by the share of equal signature values, far below the threshold, and decided by exact Jaccard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.leaks import words_of
from cairn.plans.arrow import sliced
from cairn.plans.lineage import cut
from cairn.plans.skew import salted_join
from cairn.plans.spread import spread

SHINGLE, THRESHOLD = 5, 0.8
HASHES, BINS, ROWS = 12, 16, 4
#: Below the threshold by so much (in shares of equal signature values) a candidate is dropped; five standard deviations.
SLACK = 0.2
#: A leaf leaves its bucket if its share of equal values with the centre is that high, and is met over the centre if that low.
LINKED, NEAR = 0.6, 0.1
SMALL, MAX_ROUNDS = 16, 12
#: Pairs that may be broadcast; rows left in buckets that are settled by pairs at once, whatever their buckets.
MAX_SENT, FEW = 20_000, 1000

_rng = np.random.default_rng(20_240_607)
_MULTIPLY = _rng.integers(1, 2**63, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, size=HASHES, dtype=np.uint64)
#: For each bin the bins it turns to when empty, in order.
_TURNS = np.stack([_rng.permutation(BINS) for _ in range(BINS)])
_BIN_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(60)
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000 and len(word) <= 40:  # bounds memory only
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[str], size: int, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words."""
    codes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = h * _P + codes[j : j + n]
    return np.unique(_mix(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES x BINS values of a set that isn't empty."""
    h = np.sort(_mix(shingles[None, :] * _MULTIPLY[:, None] + _ADD[:, None]), axis=1)  # the bin is the top four bits
    out = np.empty((HASHES, BINS), dtype=np.uint64)
    for i in range(HASHES):
        at = np.searchsorted(h[i], _BIN_STARTS)
        full = np.diff(np.append(at, h.shape[1])) > 0
        row = h[i][np.minimum(at, h.shape[1] - 1)]
        if not full.all():
            turns = _TURNS[~full]
            row[~full] = row[turns[np.arange(len(turns)), full[turns].argmax(axis=1)]]
        out[i] = row
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(-1, ROWS)
    h = np.arange(1, len(parts) + 1, dtype=np.uint64) * _P
    for j in range(ROWS):
        h = _mix(h * _P + parts[:, j])
    return h


def signatures(df: DataFrame, key: str, text: str, shingle: int = SHINGLE, least_words: int = SHINGLE) -> DataFrame:
    """key, cls (hash of the set), bands (array of bigint), sig (array of tinyint) of texts with at least ``least_words`` words."""
    schema = T.StructType([df.schema[key], T.StructField("cls", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType(), False)), T.StructField("sig", T.ArrayType(T.ByteType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in sliced(batches):
            at, cls, bands, sigs = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = words_of(t)
                if len(words) < max(least_words, shingle):
                    continue
                s = shingle_set(words, shingle, known)
                sig = signature(s)
                at.append(i)
                cls.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                bands.append(_bands(sig).view(np.int64))
                sigs.append((sig.ravel() & np.uint64(0xFF)).astype(np.uint8).view(np.int8))
            lists = lambda rows, width, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(np.concatenate(rows) if rows else np.empty(0, kind)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(np.array(cls, dtype=np.uint64).view(np.int64)), lists(bands, HASHES * BINS // ROWS, np.int64), lists(sigs, HASHES * BINS, np.int8)], names=schema.names
            )

    return spread(df.select(key, text)).mapInArrow(run, schema)


def _sets(df: DataFrame, text: str, shingle: int) -> DataFrame:
    """cls and shingles of rows with cls and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in sliced(batches):
            sets = [shingle_set(words_of(t), shingle, known) for t in batch.column(1).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["cls", "shingles"])

    return df.select("cls", text).mapInArrow(run, "cls bigint, shingles array<bigint>")


def _alike(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with alike, the share of equal signature values. Few pairs are sent to the signatures, not the other way."""
    if pairs.limit(MAX_SENT + 1).count() <= MAX_SENT:
        pairs = F.broadcast(pairs)
    one = sigs.select(F.col("cls").alias("a"), F.col("sig").alias("_x"))
    two = sigs.select(F.col("cls").alias("b"), F.col("sig").alias("_y"))
    equal = F.aggregate(F.zip_with("_x", "_y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return one.join(pairs, "a").join(two, "b").select("a", "b", (equal / F.lit(HASHES * BINS)).alias("alike"))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _within(rows: DataFrame) -> DataFrame:
    """Distinct pairs a < b of classes that share a band."""
    other = rows.select("band", F.col("cls").alias("b"))
    return rows.select("band", F.col("cls").alias("a")).join(other, "band").where(F.col("a") < F.col("b")).select("a", "b").distinct()


def _stars(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges a, b, alike of all stars, from centre to leaf, and the pairs a < b of the buckets that are settled by pairs.

    Round by round every bucket gets a centre; leaves unlike it stay for the next round.
    """
    rows, priority = sigs.select(F.explode("bands").alias("band"), "cls"), F.xxhash64("cls", "band")
    stars: list[DataFrame] = []
    settled: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        # the sums of a bucket are exchanged without its members; most buckets have one member and go no further
        full = rows.groupBy("band").agg(F.min(priority).alias("least"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
        held = cut(rows.join(full, "band"))
        centres = held.where(priority == F.col("least")).select("band", F.col("cls").alias("centre")).distinct()
        leaves = cut(held.join(centres, "band").where(F.col("cls") != F.col("centre")).select("band", "cls", "centre", "size"))
        edges = cut(_alike(leaves.select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct(), sigs))
        stars.append(edges)
        unlike = edges.where(F.col("alike") < LINKED).select(F.col("a").alias("centre"), F.col("b").alias("cls"))
        left = cut(leaves.join(unlike, ["centre", "cls"], "left_semi").select("band", "cls", "size"))
        few = left.limit(FEW + 1).count() <= FEW
        settled.append(_within(left if few else left.where(F.col("size") <= SMALL)))
        rows = left.where(F.col("size") > SMALL).select("band", "cls")
        if few or rows.isEmpty():
            break
    else:  # what no centre was like, exactly
        settled.append(_within(rows))
    return reduce(DataFrame.unionByName, stars), reduce(DataFrame.unionByName, settled)


def _met_over(near: DataFrame, odd: DataFrame, threshold: float) -> DataFrame:
    """Pairs of two leaves of a centre, of ``near`` and ``odd`` (a, b, alike, and g), that may be alike. Leaves of equal g aren't paired.

    |d(a,x) - d(a,y)| is at most d(x,y), with room for the error of both estimates; one of them must be linked to the centre, as two
    unlinked leaves meet in a later round. A centre of very many leaves is dealt to many tasks.
    """
    left, right = (d.select("a", F.col("b").alias(v), F.col("alike").alias(f"{v}s"), F.col("g").alias(f"{v}g")) for d, v in ((near, "x"), (odd, "y")))
    met = salted_join(left, right, "a", "x").where((F.greatest("xs", "ys") >= LINKED) & (F.abs(F.col("xs") - F.col("ys")) <= 1 - threshold + SLACK))
    return met.where(F.col("xg") != F.col("yg")).select(*_ordered(F.col("x"), F.col("y"))).distinct()


def candidate_pairs(sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of classes worth an exact look; ``sigs`` has one row a class with cls, bands and sig."""
    least = F.lit(threshold - SLACK)
    stars, settled = _stars(sigs)
    near = stars.where(F.col("alike") >= NEAR).withColumn("g", F.col("b"))
    over = _met_over(near, near.where(F.col("alike") >= LINKED), threshold)
    star = stars.where(F.col("alike") >= least).select(*_ordered(F.col("a"), F.col("b")))
    return star.unionByName(_alike(over.unionByName(settled).distinct(), sigs).where(F.col("alike") >= least).select("a", "b")).distinct()


def _read(df: DataFrame, key: str, text: str, shingle: int, least_words: int | None) -> tuple[DataFrame, DataFrame]:
    """Membership (key, cls), and for one text of every class its key, bands and signature."""
    whole = cut(signatures(df, key, text, shingle, max(least_words or shingle, shingle)))
    kept = whole.dropDuplicates(["cls"])  # any row of a class will do: their sets are equal
    return whole.select(key, "cls"), cut(kept.select("cls", key, "bands", "sig"))


def _links(pairs: DataFrame, df: DataFrame, sigs: DataFrame, key: str, text: str, shingle: int, threshold: float) -> DataFrame:
    """a, b, jaccard of those ``pairs`` that reach the threshold exactly."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    texts = df.select(key, text).join(sigs.select("cls", key).join(needed, "cls", "left_semi"), key).dropDuplicates(["cls"])
    sets = cut(_sets(texts, text, shingle))
    one = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("_x"))
    two = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("_y"))
    common = F.size(F.array_intersect("_x", "_y"))
    judged = pairs.join(one, "a").join(two, "b").select("a", "b", (common / (F.size("_x") + F.size("_y") - common)).alias("jaccard"))
    return judged.where(F.col("jaccard") >= threshold)


def near_duplicates(df: DataFrame, key: str, text: str, shingle: int = SHINGLE, threshold: float = THRESHOLD, least_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership (key, cls) and links (a, b, jaccard) between classes a < b of Jaccard similarity at least ``threshold``.

    All links, which may be as many as the pairs of a family of similar texts: see :func:`near_duplicate_groups` for the families.

    * texts of fewer than ``least_words`` words (at least ``shingle``), null and empty texts have no class;
    * texts with equal sets of shingles share a class; copies aren't paired with each other;
    * a key must have one text; repeated rows give repeated membership and change no link; an empty table gives empty results; very long texts are read
      whole; columns other than ``key`` and ``text`` are ignored.
    """
    members, sigs = _read(df, key, text, shingle, least_words)
    return members, _links(cut(candidate_pairs(sigs, threshold)), df, sigs, key, text, shingle, threshold)


def near_duplicate_groups(df: DataFrame, key: str, text: str, shingle: int = SHINGLE, threshold: float = THRESHOLD, least_words: int | None = None) -> DataFrame:
    """key, cls and component: texts that a chain of links joins have the same component, the smallest cls in it.

    The links are those of :func:`near_duplicates`, but not all are sought. The edges of the stars come first and give components; then
    leaves of a centre meet only if they lie in different ones. A family whose members are like its centres costs its stars
    and nothing more, where all its links would be as many as its pairs. Hard rows as there.
    """
    members, sigs = _read(df, key, text, shingle, least_words)
    stars, settled = _stars(sigs)
    least = F.lit(threshold - SLACK)
    star = stars.where(F.col("alike") >= least).select(*_ordered(F.col("a"), F.col("b")))
    pairs = star.unionByName(_alike(settled.distinct(), sigs).where(F.col("alike") >= least).select("a", "b")).distinct()
    label = components(sigs, _links(cut(pairs), df, sigs, key, text, shingle, threshold))
    of = lambda c, g: label.select(F.col("cls").alias(c), F.col("component").alias(g))
    near = cut(stars.where(F.col("alike") >= NEAR).join(of("b", "g"), "b").join(of("a", "_ga"), "a"))
    # of two leaves in different components one at least is in another than the centre
    over = _met_over(near, near.where(F.col("g") != F.col("_ga")), threshold)
    more = cut(_alike(over, sigs).where(F.col("alike") >= least).select("a", "b"))
    if not more.isEmpty():
        across = _links(more, df, sigs, key, text, shingle, threshold).join(of("a", "_ga"), "a").join(of("b", "_gb"), "b")
        joined = components(label.select(F.col("component").alias("cls")), across.where(F.col("_ga") != F.col("_gb")).select(F.col("_ga").alias("a"), F.col("_gb").alias("b")))
        label = label.join(joined.select(F.col("cls").alias("component"), F.col("component").alias("_to")), "component").select("cls", F.col("_to").alias("component"))
    return members.join(label, "cls").select(key, "cls", "component")


def document_pairs(documents: DataFrame, members: DataFrame, links: DataFrame, key: str = "doc_id", by: str = "hash") -> DataFrame:
    """All pairs doc_a < doc_b of documents in one class or in linked classes. Many rows for many copies: a report, not a step."""
    held = cut(documents.select(key, by).join(members, by).select(key, "cls"))
    left, right = held.select(F.col(key).alias("x"), F.col("cls").alias("a")), held.select(F.col(key).alias("y"), F.col("cls").alias("b"))
    same = left.join(right, F.col("a") == F.col("b")).where(F.col("x") < F.col("y"))
    across = left.join(links, "a").join(right, "b")
    ends = lambda d: d.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    return ends(same).unionByName(ends(across)).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """cls and component (the smallest cls reachable) of every cls in ``nodes``, by least neighbours and pointer jumping.

    Each round is two joins on cls over a written table; rounds grow with the logarithm of the longest chain.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(nodes.select("cls").distinct().withColumn("component", F.col("cls")))
    while True:
        seen = both.join(label.select(F.col("cls").alias("b"), F.col("component").alias("o")), "b").groupBy(F.col("a").alias("cls")).agg(F.min("o").alias("o"))
        lower = label.join(seen, "cls", "left").select("cls", F.col("component").alias("was"), F.least("component", "o").alias("mid"))
        jump = label.select(F.col("cls").alias("mid"), F.col("component").alias("far"))
        moved = cut(lower.join(jump, "mid").select("cls", "was", F.least("mid", "far").alias("component")))
        label = moved.select("cls", "component")
        if moved.where("component <> was").isEmpty():
            return label


