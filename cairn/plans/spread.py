"""Using all cores on inputs that come in few pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to as many tasks as the cluster runs at once if its scan has fewer than half as many.

    A file of one row group is read by one task, and so would be all costly work on its rows. Inputs in many pieces, as all large
    ones are, stay as they are: nothing is exchanged. Rows don't change.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # has exchanges of its own
        return df
    cores = spark.sparkContext.defaultParallelism
    # the number of pieces is known from planning; nothing runs
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else df
