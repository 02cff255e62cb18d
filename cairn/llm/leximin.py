"""One ranking from lists of scores on different scales: leximin over percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.lineage import cut
from cairn.plans.ranking import HOT_ROWS, numbered


def _parts(ranked: DataFrame, query: str, list_: str, item: str, score: str, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows that count, as q, l, item and score: those of queries of at most ``hot_rows`` rows, and those of larger ones, if any."""
    valid = ranked.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull())
    valid = valid.select(F.col(query).alias("q"), F.col(list_).alias("l"), F.col(item).alias("item"), F.col(score).alias("score"))
    hot = valid.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(F.col("q").alias("_q"))
    hot = cut(hot)  # at most rows / hot_rows queries
    if hot.isEmpty():
        return valid, None
    on = valid["q"].eqNullSafe(hot["_q"])
    return valid.join(F.broadcast(hot), on, "left_anti"), valid.join(F.broadcast(hot), on, "left_semi")


def _finished(per_item: DataFrame) -> DataFrame:
    n, present = F.col("n_lists"), F.size("v").cast("bigint")
    return per_item.select(
        "q", "item", "n_lists", present.alias("present"), F.when(present == n, F.col("worst")).alias("worst_rank"),
        F.concat(F.array_repeat(F.lit(0.0), (n - present).cast("int")), F.col("v")).alias("weakest_first"),
    )


def _vectors(rows: DataFrame) -> DataFrame:
    """All of a query in one task: one exchange, by query, serves every grouping and window."""
    best = rows.repartition("q").groupBy("q", "l", "item").agg(F.max("score").alias("score"))
    in_list, by_list = Window.partitionBy("q", "l"), Window.partitionBy("q").orderBy("l")
    ranks = best.select("q", "l", "item", F.row_number().over(in_list.orderBy(F.desc("score"), "item")).cast("bigint").alias("rank"), F.dense_rank().over(by_list).alias("nth"))
    sized = ranks.select("q", "item", "rank", F.count(F.lit(1)).over(in_list).alias("size"), F.max("nth").over(Window.partitionBy("q")).cast("bigint").alias("n_lists"))
    p = (F.col("size") - F.col("rank") + 1) / F.col("size")
    # the array of an item has at most one entry a list
    return _finished(sized.groupBy("q", "item").agg(F.sort_array(F.collect_list(p)).alias("v"), F.max("rank").alias("worst"), F.max("n_lists").alias("n_lists")))


def _hot_vectors(rows: DataFrame, hot_rows: int) -> DataFrame:
    """The same with the rows of a query, and of a list, over many tasks."""
    best = cut(rows.groupBy("q", "l", "item").agg(F.max("score").alias("score")))
    placed = numbered(best, ["q", "l"], [F.desc("score"), F.asc("item")], "rank", hot_rows)
    sizes = best.groupBy("q", "l").agg(F.count(F.lit(1)).alias("size"))
    n = sizes.groupBy("q").agg(F.count(F.lit(1)).alias("n_lists")).withColumnRenamed("q", "_q")
    s = sizes.withColumnsRenamed({"q": "_q", "l": "_l"})
    rated = placed.join(s, placed["q"].eqNullSafe(s["_q"]) & placed["l"].eqNullSafe(s["_l"]))
    p = (F.col("size") - F.col("rank") + 1) / F.col("size")
    per_item = rated.groupBy("q", "item").agg(F.sort_array(F.collect_list(p)).alias("v"), F.max("rank").alias("worst"))
    return _finished(per_item.join(F.broadcast(n), per_item["q"].eqNullSafe(n["_q"])).drop("_q"))  # n has one row a hot query


def leximin_vectors(ranked: DataFrame, query: str = "query_id", list_: str = "list_id", item: str = "filepath", score: str = "backend_score", hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each item of each query its percentiles in the query's lists, ascending.

    Columns: ``query``, ``item``, n_lists (lists of the query), present (lists that hold the item), worst_rank (its largest rank
    in any list, null if a list lacks it), weakest_first (array of n_lists percentiles; 0.0 for a list that lacks it).
    The percentile of rank r among n items of a list is (n - r + 1) / n; ranks go by descending score, then by smaller item.

    * rows with null or NaN score or null item are left out, and a list without others doesn't exist;
    * an item counts once per list with its highest score, so repeated rows change nothing;
    * null query or list ids are ids of their own; infinite scores rank first or last; an empty table gives no rows;
    * other columns are ignored; queries of more than ``hot_rows`` rows go over many tasks.
    """
    rows, hot = _parts(ranked, query, list_, item, score, hot_rows)
    made = _vectors(rows) if hot is None else _vectors(rows).unionByName(_hot_vectors(hot, hot_rows))
    return made.withColumnsRenamed({"q": query, "item": item})


def leximin_ranking(ranked: DataFrame, query: str = "query_id", list_: str = "list_id", item: str = "filepath", score: str = "backend_score", hot_rows: int = HOT_ROWS) -> DataFrame:
    """:func:`leximin_vectors` with ``position``, from 1 in each query: larger vectors first by element, then the smaller item.

    The weakest percentiles are compared first, so no list rules by its range and no strong score hides a weak one.
    """
    rows, hot = _parts(ranked, query, list_, item, score, hot_rows)
    order = [F.desc("weakest_first"), F.asc("item")]
    made = _vectors(rows).withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy(*order)).cast("bigint"))
    if hot is not None:
        made = made.unionByName(numbered(cut(_hot_vectors(hot, hot_rows)), ["q"], order, "position", hot_rows))
    return made.withColumnsRenamed({"q": query, "item": item})


def strong_everywhere(vectors: DataFrame, first: int = 3, lists: int = 2) -> DataFrame:
    """Rows whose weakest percentile is above 0 (no list lacks the item), held against the rank: among the first of every list."""
    return vectors.where((F.col("weakest_first")[0] > 0) & (F.col("worst_rank") <= first) & (F.col("n_lists") >= lists))
