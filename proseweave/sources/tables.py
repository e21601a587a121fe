"""Reading Parquet tables with a task count that fits the work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy row work enough tasks. A table that Spark scans with at least one task per core is left
    alone; one of fewer splits (one small file) is hashed, into as many parts as Spark sees fit."""
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(*keys)
