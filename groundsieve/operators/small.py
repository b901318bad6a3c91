"""Broadcast behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

DEFAULT_BOUND = 100_000


def checked_broadcast(df: DataFrame, bound: int = DEFAULT_BOUND) -> DataFrame:
    """Broadcast ``df`` and fail the job, rather than the executors, if it has more than
    ``bound`` rows. For frames whose size is bounded by a code list, a mesh or a parameter.

    Every task stops at one row above the bound before rows meet to be counted.
    """
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    stop = F.raise_error(F.lit(f"table to broadcast has more than {bound} rows")).cast("boolean")
    counted = df.limit(bound + 1).withColumn("_n", n).where(F.when(F.col("_n") > bound, stop).otherwise(F.lit(True)))
    return F.broadcast(counted.drop("_n"))
