"""Retrieval quality by tier, and percentiles of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import path_hit

# The least hit rates by search mode: easy at 3, medium at 3, hard at 5, all at 3.
GATES = {"bm25": (0.80, 0.15, 0.15, 0.40), "vector": (0.60, 0.40, 0.30, 0.50), "hybrid": (0.80, 0.50, 0.30, 0.60)}


def hits(results: DataFrame, expected: DataFrame, at: int, key: str = "query_id", rank: str = "rank") -> DataFrame:
    """key, difficulty and hit of each expected row (key, expected_doc, difficulty): whether a path among the first ``at`` holds it.

    A query without results is a miss; a null expectation is a miss.
    """
    top = results.where(F.col(rank) <= at).select(key, "filepath")
    both = expected.select(key, "expected_doc", "difficulty").join(top, key, "left")
    return both.groupBy(key, "difficulty").agg(F.coalesce(F.bool_or(path_hit(F.col("filepath"), F.col("expected_doc"))), F.lit(False)).alias("hit"))


def hit_rates(results: DataFrame, expected: DataFrame, key: str = "query_id", rank: str = "rank") -> DataFrame:
    """difficulty, k, n, hits and rate at 1, 3, 5 and 10; the rows of difficulty 'all' are over every query."""
    cuts = F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10)])).alias("k")
    best = results.select(key, "filepath", F.col(rank).alias("_rank"))
    both = expected.select(key, "expected_doc", "difficulty").join(best, key, "left")
    first = both.groupBy(key, "difficulty").agg(F.min(F.when(path_hit(F.col("filepath"), F.col("expected_doc")), F.col("_rank"))).alias("first"))
    each = first.select(F.explode(F.array(F.col("difficulty"), F.lit("all"))).alias("difficulty"), "first", cuts)
    return each.groupBy("difficulty", "k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") <= F.col("k")).alias("hits")).withColumn("rate", F.round(F.col("hits") / F.col("n"), 6))


def gates(rates: DataFrame, mode: str) -> DataFrame:
    """difficulty, k, rate, least, passed for the tiers that are gated. Callers treat a row that didn't pass as a failure."""
    easy, medium, hard, overall = GATES[mode]
    wanted = rates.sparkSession.createDataFrame([("easy", 3, easy), ("medium", 3, medium), ("hard", 5, hard), ("all", 3, overall)], "difficulty string, k int, least double")
    found = wanted.join(rates, ["difficulty", "k"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    return found.select("difficulty", "k", "rate", "least", (F.col("rate") >= F.col("least")).alias("passed"))


def nearest_rank(value: str, p: float) -> Column:
    """The value at rank ceil(n * p), an aggregate."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, p50 and p99 (nearest rank) of ``value``; nulls don't count."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), nearest_rank(value, 0.5).alias("p50"), nearest_rank(value, 0.99).alias("p99"))
