"""Reciprocal rank fusion of ranked lists, and blending with a reranker's scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.schemas import BLEND_RERANK, RRF_BONUS_FIRST, RRF_BONUS_NEXT, RRF_K, WEIGHT_ORIGINAL, WEIGHT_OTHER


def list_weight(query_type: Column) -> Column:
    """Lists of the original query weigh twice."""
    return F.when(F.lower(query_type) == "original", F.lit(WEIGHT_ORIGINAL)).otherwise(F.lit(WEIGHT_OTHER))


def list_ranks(lists: DataFrame, score: str = "backend_score") -> DataFrame:
    """query_id, list_id, filepath, weight, rank from 0: the first place of each filepath in each list.

    Rows with null score or filepath are left out. Ties go to the smaller filepath; the weight is that of the best row.
    """
    valid = lists.where(F.col(score).isNotNull() & F.col("filepath").isNotNull())
    best = valid.groupBy("query_id", "list_id", "filepath").agg(F.max(F.struct(F.col(score).alias("s"), "weight")).alias("_b"))
    order = Window.partitionBy("query_id", "list_id").orderBy(F.desc("_b.s"), "filepath")
    return best.select("query_id", "list_id", "filepath", F.coalesce("_b.weight", F.lit(WEIGHT_OTHER)).alias("weight"), (F.row_number().over(order) - 1).cast("bigint").alias("rank"))


def fuse(lists: DataFrame, limit: int | None = None, score: str = "backend_score", digits: int = 6) -> DataFrame:
    """query_id, filepath, score, best_rank, n_lists and position (from 1) of the fused list of each query.

    A document has weight / (60 + rank + 1) from each list, and a bonus once by its best rank in any: 0.05 for the first, 0.02 for
    the next two. The order of lists doesn't matter. Ties go to the smaller filepath.
    """
    placed = list_ranks(lists, score)
    summed = placed.groupBy("query_id", "filepath").agg(F.sum(F.col("weight") / (RRF_K + 1 + F.col("rank"))).alias("_s"), F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("n_lists"))
    bonus = F.when(F.col("best_rank") == 0, RRF_BONUS_FIRST).when(F.col("best_rank") <= 2, RRF_BONUS_NEXT).otherwise(0.0)
    fused = summed.withColumn("score", F.round(F.col("_s") + bonus, digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "filepath")
    out = fused.withColumn("position", F.row_number().over(order).cast("bigint"))
    if limit is not None:
        out = out.where(F.col("position") <= limit)
    return out.select("query_id", "filepath", "score", "best_rank", "n_lists", "position")


def blend(fused: DataFrame, reranked: DataFrame, limit: int, digits: int = 6) -> DataFrame:
    """``fused`` with blended scores and new positions; ``reranked`` (query_id, filepath, rerank_score) may lack some or all.

    A document without a reranker's score keeps its fused one. Of repeated scores the highest counts.
    """
    given = reranked.groupBy("query_id", "filepath").agg(F.max("rerank_score").alias("_r"))
    mixed = F.round(F.coalesce(BLEND_RERANK * F.col("_r") + (1 - BLEND_RERANK) * F.col("score"), F.col("score")), digits)
    both = fused.drop("position").join(given, ["query_id", "filepath"], "left").withColumn("score", mixed).drop("_r")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "filepath")
    return both.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= limit)
