"""Parallelism guard for CPU-heavy per-row work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """Spread ``df`` over ``min_partitions`` tasks when it arrives in fewer.

    Large inputs already come in many splits and are returned unchanged, and so is what a
    shuffle delivers (adaptive execution sizes that). An input in fewer splits (e.g. one
    parquet row group) is round-robined and checkpointed to the shared checkpoint folder: a
    repartition alone is no barrier, because Catalyst pushes filters on evaluated columns
    below it into the single scan task. The checkpoint is reliable (it survives executor
    loss) and cuts the lineage. With ``materialize=False`` only the round-robin is applied
    (for pure projections, or when a later checkpoint already acts as the barrier).
    """
    from ..session import ensure_checkpoint_dir

    spark = df.sparkSession
    n = min_partitions or spark.sparkContext.defaultParallelism
    # counting the splits of an adaptive plan would run its shuffle stages
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan" or df.rdd.getNumPartitions() >= n:
        return df
    if not materialize:
        return df.repartition(n)
    ensure_checkpoint_dir(spark)
    return df.repartition(n).checkpoint(eager=True)
