"""Writing examples, scores and reports; ``test_files`` writes tests."""

from __future__ import annotations

from pyspark.sql import DataFrame

def write_jsonl(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Newline-delimited JSON, for example examples by ``split``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet table, optionally partitioned; only the written partitions are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.parquet(path)
