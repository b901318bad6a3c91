"""Run summaries (nested JSON, one document per file) to one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

FOLD = "array<struct<fold:int,n_train:bigint,n_test:bigint,rmse:double,mae:double,std_mean:double>>"
SUMMARY = f"run_name string, n_samples bigint, wall_clock_s double, spatial_kfold {FOLD}, regime_distribution map<string,bigint>"


def read_summaries(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.schema(SUMMARY).option("multiLine", True).json(list(paths))


def fold_means(summaries: DataFrame) -> DataFrame:
    """One row per run: number of folds and fold means."""
    f = summaries.select("run_name", F.inline("spatial_kfold"))
    return f.groupBy("run_name").agg(
        F.count(F.lit(1)).alias("n_folds"), F.sum("n_test").alias("n_test"), F.avg("rmse").alias("rmse_mean"),
        F.avg("mae").alias("mae_mean"), F.avg("std_mean").alias("std_mean"))
