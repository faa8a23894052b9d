"""Access to the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; one that arrives in fewer splits than there are cores (a single small file) is spread over the cores,
    a large one is read as it lies."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
