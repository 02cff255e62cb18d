"""Equi joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, share: float = 0.002) -> DataFrame:
    """Keys holding more than ``share`` of the rows with a key: by counting, at most 1/share rows, so it may be broadcast."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    return counts.where(F.col("_n") > F.lit(share) * total.scalar()).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 32, share: float = 0.002) -> DataFrame:
    """Inner join on ``key`` in which the left rows of a hot key are dealt to ``salts`` tasks by a hash of ``spread``.

    Only the right rows of hot keys (keys above ``share`` of the left rows) are repeated. ``right`` should have few rows a key.
    The result keeps the column ``_salt``, so that a later grouping by (key, _salt, ...) needs no further exchange.
    Null keys match nothing, as in any equi join.
    """
    hot = F.broadcast(hot_keys(left, key, share).withColumn("_hot", F.lit(True)))
    dealt = left.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    every = F.array(*[F.lit(i) for i in range(salts)])
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(copied, [key, "_salt"])
