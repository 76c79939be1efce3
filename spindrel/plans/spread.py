"""Small inputs on all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has cores.

    Only an input of fewer splits is dealt out anew, which is a small one; larger ones stay where they are read. A plan
    that shuffles already is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
