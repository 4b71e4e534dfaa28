"""Reading parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as it is laid out."""
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over all cores when the scan has fewer splits than cores.

    For work that is heavy per row, such as text measures: a small file is read by
    one task however many cores are idle.  A large table has more splits than
    cores and passes through untouched, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
