"""Row numbers within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.lineage import cut

#: Groups above so many rows are numbered over many tasks. Has no influence on results.
HOT_ROWS = 200_000


def _same(group: list[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_g_{c}"]) for c in group])


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``out``, the number from 1 of each row in its ``group`` by ``order``, which should decide all ties.

    Groups of at most ``hot_rows`` rows are numbered by a window. Larger ones are range-partitioned by group and order, numbered
    within each range, and moved by the sizes of the ranges before: no task holds a whole group. Null keys form a group.
    """
    plain = Window.partitionBy(*group).orderBy(*order)
    hot = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*[F.col(c).alias(f"_g_{c}") for c in group])
    if hot.isEmpty():
        return df.withColumn(out, F.row_number().over(plain).cast("bigint"))
    hot = F.broadcast(hot)  # at most rows / hot_rows groups
    on = _same(group, df, hot)
    cold = df.join(hot, on, "left_anti").withColumn(out, F.row_number().over(plain).cast("bigint"))
    # written once: a second evaluation could draw other range bounds
    ranged = cut(df.join(hot, on, "left_semi").repartitionByRange(*[F.col(c) for c in group], *order).withColumn("_range", F.spark_partition_id()))
    inner = Window.partitionBy("_range", *group).orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"))
    moved = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_range").alias("_r"), "_before", *[F.col(c).alias(f"_g_{c}") for c in group])
    local = ranged.withColumn("_local", F.row_number().over(inner))
    joined = local.join(moved, (local["_range"] == moved["_r"]) & _same(group, local, moved))
    return cold.unionByName(joined.withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint")).select(*df.columns, out))
