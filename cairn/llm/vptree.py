"""The most similar vectors of every vector: vantage-point trees per shard.

A tree fitted to bounded samples deals all vectors to shards: at each node by the distance to a vantage point, within or beyond a
threshold. In each shard a vantage-point tree of its own is built. A search keeps a query's radius (the distance of its k-th best
so far, or that of the least cosine asked for) and leaves out a side of a node if the triangle inequality, with the radius
multiplied by ``factor``, excludes it: factor 1 is exact, smaller ones are faster and may lose neighbours. Every vector first
searches its own shard; with the radius so found it visits the other shards that can't be excluded, at most ``MOST_VISITS`` of
them, nearest first (with factor 1 all of them), so that what is exchanged grows with the vectors and not with the shards.

A vantage point need not be a stored vector. The direction of largest spread and the middle of the nearer half around a few rows
are tried, and the point and threshold are taken which have the fewest distances near the threshold: these are the queries that
would have to visit both sides.

Distances are Euclidean between normalised vectors, which order as cosines do. Equal vectors are searched once for all vids that
hold them.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.arrow import by_slice
from cairn.plans.lineage import cut
from cairn.plans.skew import salted_join

DIM, K = 64, 5
#: The factor used where none is given is so much over the square root of the dimension (0.15 for 64): the distances of two vectors r
#: apart to a vantage point differ by about r over that root, and by twice as much in one case of twenty.
SHARE = 1.2
#: The factor within a shard is larger by so much (1 at most): what is left out there saves no exchange.
WITHIN = 4 / 3
#: Other shards that a vector visits at most, unless the factor is 1.
MOST_VISITS = 32
#: Vectors aimed at a shard (no shard holds more than four times as many that differ in distance), vectors in a sample that a tree is
#: fitted to, vectors in a leaf of a shard's tree, and queries that meet a shard in one task.
SHARD_ROWS, SAMPLE, LEAF, QUERIES = 16_384, 20_000, 256, 65_536
#: Shards at most, which bounds the tree that is sent to every task (0.3 kB a shard). Above MAX_SHARDS * SHARD_ROWS = 4e9 vectors
#: shards grow instead: at 4e11 they hold 1.6 million vectors, 0.4 GB.
MAX_SHARDS = 262_144
#: Rows looked at for a split, rows tried as centres of a half, half-width of the zone around a threshold that should be empty, and the
#: quantiles tried as thresholds.
LOOKED, TRIED, ZONE, QUANTILES = 2000, 4, 0.15, (0.3, 0.4, 0.5, 0.6, 0.7)


class _Top:
    """The k best of each query so far, no worse than ``least``."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.cos = np.full((n, k), -np.inf, dtype=np.float32)
        self.at = np.full((n, k), -1, dtype=np.int64)
        self.least = least.astype(np.float32)

    def offer(self, rows: np.ndarray, cos: np.ndarray, at: np.ndarray) -> None:
        better = np.flatnonzero(cos.max(axis=1) > self.bar(rows)) if cos.shape[1] else ()
        if not len(better):
            return
        rows, k = rows[better], self.cos.shape[1]
        c = np.concatenate([self.cos[rows], cos[better]], axis=1)
        i = np.concatenate([self.at[rows], np.broadcast_to(at, (len(rows), len(at)))], axis=1)
        best = np.argpartition(-c, k - 1, axis=1)[:, :k]
        self.cos[rows], self.at[rows] = np.take_along_axis(c, best, 1), np.take_along_axis(i, best, 1)

    def bar(self, rows: np.ndarray) -> np.ndarray:
        """The cosine that a newcomer must beat."""
        return np.maximum(self.cos[rows].min(axis=1), self.least[rows])

    def radius(self, rows: np.ndarray) -> np.ndarray:
        return _radius(self.bar(rows))


def default_factor(dim: int) -> float:
    return min(1.0, SHARE / math.sqrt(dim))


def _radius(bar: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * np.maximum(bar, -1), 0))


def _distance(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ point), 0))


def _vantage(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
    """Vantage point and threshold for the rows of ``x``; None if no point tried separates them."""
    y = x if len(x) <= LOOKED else x[rng.choice(len(x), LOOKED, replace=False)]
    points = []
    spread = np.linalg.eigh(np.cov(y.T.astype(np.float64)))[1][:, -1] if len(y) > 1 else y[0]
    points.append(spread)
    for row in rng.choice(len(y), size=min(TRIED, len(y)), replace=False):
        p = y[row]
        for _ in range(3):  # the middle of the nearer half, of its nearer half, and so on to one of two clusters
            middle = y[np.argsort(-(y @ p))[: max(1, len(y) // 2)]].mean(axis=0)
            length = np.linalg.norm(middle)
            if length < 1e-6:
                break
            p = middle / length
        points += [p, y[row]]
    best = None
    for p in points:
        p = np.asarray(p, dtype=np.float32)
        d = _distance(y, p)
        for at in np.quantile(d, QUANTILES):
            inner = d <= at
            if inner.all():
                at = np.nextafter(np.float32(at), np.float32(-1))  # ties at the far end go beyond it
                inner = d <= at
            if not inner.any() or inner.all():
                continue
            near = float((np.abs(d - at) <= ZONE).mean())
            if best is None or near < best[0]:
                best = near, p, float(at)
    return best and best[1:]


class VPTree:
    """A tree over the rows of ``x`` (normalised): nodes are [vantage point, threshold, inner, outer] or row numbers."""

    def __init__(self, x: np.ndarray, leaf: float, seed: int = 7):
        self.x = x
        self.nodes: list = []
        rng = np.random.default_rng(seed)
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            here = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + side] = here
            split = _vantage(x[rows], rng) if len(rows) > leaf else None
            inner = _distance(x[rows], split[0]) <= split[1] if split else np.ones(0, bool)
            if inner.all() or not inner.any():
                self.nodes.append(rows)
                continue
            self.nodes.append([*split, -1, -1])
            todo += [(rows[~inner], here, 1), (rows[inner], here, 0)]

    def home(self, q: np.ndarray) -> np.ndarray:
        """The leaf node to which each query belongs."""
        out = np.zeros(len(q), dtype=np.int32)
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            at = self.nodes[node]
            if not len(rows) or isinstance(at, np.ndarray):
                out[rows] = node
                continue
            inner = _distance(q[rows], at[0]) <= at[1]
            todo += [(at[2], rows[inner]), (at[3], rows[~inner])]
        return out

    def visited(self, q: np.ndarray, radius, factor: float):
        """(leaf node, queries that must visit it); ``radius`` maps query numbers to radii, and is asked at each node again."""
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            at = self.nodes[node]
            if isinstance(at, np.ndarray):
                yield node, rows
                continue
            d, reach = _distance(q[rows], at[0]), radius(rows) * factor
            todo += [(at[3], rows[d > at[1] - reach]), (at[2], rows[d <= at[1] + reach])]

    def search(self, q: np.ndarray, top: _Top, factor: float, own: np.ndarray | None = None) -> None:
        """Offer the rows of the tree to each query. ``own`` is the query's own row, which isn't offered."""

        def offer(leaf: np.ndarray, rows: np.ndarray) -> None:
            for at in range(0, len(rows), 4096):
                some = rows[at : at + 4096]
                cos = q[some] @ self.x[leaf].T
                if own is not None:
                    cos[own[some][:, None] == leaf[None, :]] = -np.inf
                top.offer(some, cos, leaf)

        first = None
        if own is not None:  # the leaf of a query gives it a radius to start with
            first = self.home(q)
            for node in np.unique(first):
                offer(self.nodes[node], np.flatnonzero(first == node))
        for node, rows in self.visited(q, top.radius, factor):
            offer(self.nodes[node], rows if first is None else rows[first[rows] != node])


class ShardTree:
    """The tree that deals vectors to shards, as arrays. Shards are numbered by its leaves.

    A distance depends on the two vectors alone, not on the rows beside them, so that a vector's shard is the same in every pass.
    """

    def __init__(self, tree: VPTree, dim: int):
        inner = [not isinstance(at, np.ndarray) for at in tree.nodes]
        self.point = np.array([at[0] if i else np.zeros(dim) for at, i in zip(tree.nodes, inner)], dtype=np.float32).reshape(-1, dim)
        self.limit = np.array([at[1] if i else 0.0 for at, i in zip(tree.nodes, inner)])
        self.near = np.array([at[2] if i else -1 for at, i in zip(tree.nodes, inner)], dtype=np.int32)
        self.far = np.array([at[3] if i else -1 for at, i in zip(tree.nodes, inner)], dtype=np.int32)

    def graft(self, parts: dict[int, ShardTree]) -> None:
        """Put other trees in the place of leaves."""
        for leaf, tree in parts.items():
            at = len(self.near) - 1  # where the part's node 0 would stand: its root takes the leaf's place
            moved = lambda links: np.where(links < 0, -1, links + at).astype(np.int32)
            self.point[leaf], self.limit[leaf] = tree.point[0], tree.limit[0]
            self.near[leaf], self.far[leaf] = moved(tree.near)[0], moved(tree.far)[0]
            self.point, self.limit = np.concatenate([self.point, tree.point[1:]]), np.concatenate([self.limit, tree.limit[1:]])
            self.near, self.far = np.concatenate([self.near, moved(tree.near)[1:]]), np.concatenate([self.far, moved(tree.far)[1:]])

    def _beyond(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Distance to the nodes' vantage points less their thresholds: above 0 outside."""
        dot = (q * self.point[nodes]).sum(axis=1, dtype=np.float64)
        return np.sqrt(np.maximum(2 - 2 * dot, 0)) - self.limit[nodes]

    def home(self, q: np.ndarray) -> np.ndarray:
        at = np.zeros(len(q), dtype=np.int32)
        live = np.flatnonzero(self.near[at] >= 0)
        while len(live):
            outside = self._beyond(q[live], at[live]) > 0
            at[live] = np.where(outside, self.far[at[live]], self.near[at[live]])
            live = live[self.near[at[live]] >= 0]
        return at

    def visits(self, q: np.ndarray, radius: np.ndarray, factor: float, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Query numbers and shards they can't exclude, their own among them; beside it at most ``most``.

        Nearest are those with the least sum of squares of the distances by which a query lies beyond the thresholds on the way.
        Every node has a leaf with its own sum, so that keeping the best nodes of each level keeps the best leaves.
        """
        row, node, away = np.arange(len(q)), np.zeros(len(q), dtype=np.int32), np.zeros(len(q))
        while True:
            live = self.near[node] >= 0
            if not live.any():
                return row, node
            r, n, a = row[live], node[live], away[live]
            beyond, reach = self._beyond(q[r], n), radius[r] * factor
            i, o = beyond <= reach, beyond > -reach
            i |= ~(i | o)
            row = np.concatenate([row[~live], r[i], r[o]])
            node = np.concatenate([node[~live], self.near[n[i]], self.far[n[o]]])
            away = np.concatenate([away[~live], a[i] + np.maximum(beyond[i], 0) ** 2, a[o] + np.minimum(beyond[o], 0) ** 2])
            if most is not None and len(row) > most:
                order = np.lexsort((away, row))
                row, node, away = row[order], node[order], away[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) <= most
                row, node, away = row[kept], node[kept], away[kept]


def usable(vectors: DataFrame, vid: str = "vid", embedding: str = "embedding", dim: int = DIM) -> DataFrame:
    """vid and embedding of vectors that take part: vid not null, ``dim`` numbers, none null, NaN or infinite, not all zero.

    Of rows with one vid the least embedding counts.
    """
    x = F.col(embedding)
    ok = F.col(vid).isNotNull() & (F.size(x) == dim) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(ok).groupBy(F.col(vid).alias("vid")).agg(F.min(x).alias("embedding"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares could overflow or vanish
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, the same for (x, y) and (y, x)."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _floats(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def fit_shards(reps: DataFrame, dim: int = DIM, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE, max_shards: int = MAX_SHARDS) -> ShardTree:
    """The tree that deals ``reps`` (rep, embedding) to shards of about ``shard_rows`` vectors.

    It is fitted to ``sample`` vectors, first by a hash of rep. Shards that come out with more than four times ``shard_rows`` vectors are
    fitted again, each to a sample of its own, until none is left or none of them can be divided. All vectors are counted.
    """
    n = reps.count()
    first = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toArrow()  # bounded
    shard_rows = max(shard_rows, math.ceil(n / max_shards))
    x = _unit(_matrix(first.column(0), dim)) if first.num_rows else np.empty((0, dim), np.float32)
    tree = ShardTree(VPTree(x, max(8, shard_rows * len(x) / max(n, 1))), dim)
    if n <= len(x):
        return tree
    spark, stuck = reps.sparkSession, set()
    while True:
        dealt = _dealt(reps, tree, dim)
        large = {r.shard: r.n for r in dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * shard_rows).collect() if r.shard not in stuck}
        if not large:  # at most n / (4 * shard_rows) rows came
            return tree
        sizes = F.broadcast(spark.createDataFrame(list(large.items()), "shard int, n bigint"))
        # a share of each shard by a hash of rep, which no earlier choice used
        chosen = dealt.join(sizes, "shard").where(F.pmod(F.xxhash64("rep", F.lit("again")), F.lit(1_000_003)) * F.col("n") < F.lit(1_000_003 * min(sample, 4096)))

        def fit(table: pa.Table) -> pa.Table:
            y = _unit(_matrix(table.column("embedding"), dim))
            sub = ShardTree(VPTree(y, max(8, shard_rows * len(y) / table.column("n")[0].as_py())), dim)
            return pa.table({"shard": table.column("shard").slice(0, 1), "tree": pa.array([pickle.dumps(sub)], pa.binary())})

        parts = {r.shard: pickle.loads(r.tree) for r in chosen.groupBy("shard").applyInArrow(fit, "shard int, tree binary").collect()}
        whole = {s: t for s, t in parts.items() if len(t.near) > 1}
        stuck |= set(large) - set(whole)
        tree.graft(whole)


def _dealt(reps: DataFrame, tree: ShardTree, dim: int) -> DataFrame:
    """rep, shard and embedding."""
    shipped = reps.sparkSession.sparkContext.broadcast(tree)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shipped.value.home(_unit(_matrix(batch.column(1), dim)))), batch.column(1)], names=["rep", "shard", "embedding"])

    return reps.select("rep", "embedding").mapInArrow(by_slice(deal, 4096), "rep bigint, shard int, embedding array<float>")


def _found(ids: np.ndarray, q: np.ndarray, top: _Top, others: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, c = np.nonzero(top.at >= 0)
    at = top.at[r, c]
    return ids[r], others[at], _exact(q[r], x[at]) if len(r) else np.empty(0)


def neighbour_classes(reps: DataFrame, k: int, least_cos: float, factor: float, dim: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rep, other, cos: up to ``k`` most similar others of each of ``reps`` (rep, embedding), with cosines above ``least_cos``."""
    tree = fit_shards(reps, dim, shard_rows)
    shipped = reps.sparkSession.sparkContext.broadcast(tree)
    dealt, within, most = _dealt(reps, tree, dim), min(1.0, factor * WITHIN), MOST_VISITS if factor < 1 else None

    def at_home(table: pa.Table) -> pa.Table:
        """Rows found, and a row for every vector with its bar, its numbers and the shards it must visit."""
        q, ids, home = _matrix(table.column("embedding"), dim), table.column("rep").to_numpy(), table.column("shard")[0].as_py()
        x = _unit(q)
        top = _Top(len(x), k, np.full(len(x), least_cos))
        VPTree(x, LEAF).search(x, top, within, own=np.arange(len(x)))
        rep, other, cos = _found(ids, q, top, ids, q)
        bar = top.bar(np.arange(len(x)))
        row, to = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for at in range(0, len(x), 4096):
            r, s = shipped.value.visits(x[at : at + 4096], _radius(bar[at : at + 4096]), factor, most)
            row.append(r[s != home] + at)
            to.append(s[s != home])
        row, to = np.concatenate(row), np.concatenate(to)
        order = np.argsort(row, kind="stable")
        going, first = np.unique(row[order], return_index=True)
        n, m = len(rep), len(going)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(to[order]))
        return pa.table({
            "rep": np.concatenate([rep, ids[going]]),
            "other": pa.array(np.concatenate([other, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
            "cos": np.concatenate([cos, bar[going].astype(np.float64)]),
            "to": pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), lists]),
            "embedding": pa.concat_arrays([pa.nulls(n, pa.list_(pa.float32())), _floats(q[going])]),
        })

    home = cut(dealt.groupBy("shard").applyInArrow(at_home, "rep bigint, other bigint, cos double, to array<int>, embedding array<float>"))
    visits = home.where(F.col("other").isNull()).select("rep", F.explode("to").alias("shard"), F.col("cos").alias("bar"), "embedding")
    # a shard is repeated for every QUERIES visits, so that no task holds more; the table has one row a shard
    parts = F.broadcast(visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts")))
    left = visits.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).select("rep", "shard", "part", "bar", "embedding")
    right = dealt.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("rep", "shard", "part", "embedding")

    def abroad(queries: pa.Table, shard: pa.Table) -> pa.Table:
        rep, other, cos = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if queries.num_rows and shard.num_rows:
            ids, q, x = queries.column("rep").to_numpy(), _matrix(queries.column("embedding"), dim), _matrix(shard.column("embedding"), dim)
            top = _Top(len(ids), k, queries.column("bar").to_numpy())
            VPTree(_unit(x), LEAF).search(_unit(q), top, within)
            rep, other, cos = _found(ids, q, top, shard.column("rep").to_numpy(), x)
        return pa.table({"rep": rep, "other": other, "cos": cos})

    second = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(abroad, "rep bigint, other bigint, cos double")
    found = home.where(F.col("other").isNotNull()).select("rep", "other", "cos").unionByName(second)
    order = Window.partitionBy("rep").orderBy(F.desc("cos"), "other")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("rep", "other", "cos")


def nearest_vectors(vectors: DataFrame, vid: str = "vid", embedding: str = "embedding", k: int = K, least_cos: float | None = None, factor: float | None = None, dim: int = DIM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vid, other, cos, rank (1..k): the ``k`` other vids most similar to each usable vid, ties going to the smaller vid.

    With ``least_cos`` only neighbours of at least that cosine. ``factor`` is :func:`default_factor` unless given. Cosines are in double precision from the stored numbers.

    * vectors that :func:`usable` leaves out take no part; repeated rows of a vid count once;
    * vids with equal vectors (by a hash of 128 bits) are neighbours of cosine 1; of many such vids each gets the k smallest others, and
      the search is made once for all of them; no group of equal vectors is gathered;
    * an empty table or a single vid gives no rows; other columns are ignored.
    """
    keyed = usable(vectors, vid, embedding, dim).withColumn("h", F.struct(F.xxhash64("embedding"), F.xxhash64(F.lit("second"), "embedding")))
    sizes = keyed.groupBy("h").agg(F.min("vid").alias("_rep"), F.count(F.lit(1)).alias("size")).select("_rep", "size")
    # the first vid of a class stands for it and keeps the numbers; both sides of the join are dealt by vid already
    one = cut(keyed.join(sizes, keyed["vid"] == sizes["_rep"], "left").select("vid", "h", "size", F.when(F.col("size").isNotNull(), F.col("embedding")).alias("embedding")))
    alone = one.where(F.col("size") == 1).select("vid", F.col("vid").alias("rep"), "size")
    many = one.where(F.col("size") > 1).select("h", F.col("vid").alias("rep"), F.col("size").alias("_size"))
    shared = cut(salted_join(one.where(F.col("size").isNull() | (F.col("size") > 1)).select("vid", "h"), many, "h", "vid").select("vid", "rep", F.col("_size").alias("size")))
    members = shared.unionByName(alone)
    # neighbours to offer: the first k + 1 of each class, chosen before the exchange
    order = Window.partitionBy("rep").orderBy("vid")
    offered = alone.select("vid", "rep").unionByName(shared.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).select("vid", "rep"))
    factor = default_factor(dim) if factor is None else factor
    floor = -2.0 if least_cos is None else least_cos - 1e-6
    found = cut(neighbour_classes(one.where(F.col("size").isNotNull()).select(F.col("vid").alias("rep"), "embedding"), k, floor, factor, dim, shard_rows))
    outside = members.where(F.col("size") <= k).join(found, "rep").join(offered.select(F.col("rep").alias("other"), F.col("vid").alias("to")), "other").select("vid", "to", "cos")
    inside = shared.join(offered.select("rep", F.col("vid").alias("to")), "rep").where(F.col("vid") != F.col("to")).select("vid", "to", F.lit(1.0).alias("cos"))
    ranked = Window.partitionBy("vid").orderBy(F.desc("cos"), "to")
    best = outside.unionByName(inside).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    if least_cos is not None:
        best = best.where(F.col("cos") >= least_cos)
    return best.select("vid", F.col("to").alias("other"), "cos", "rank")


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Distinct vid_a < vid_b of which one is among the nearest of the other."""
    return neighbours.select(F.least("vid", "other").alias("vid_a"), F.greatest("vid", "other").alias("vid_b")).distinct()
