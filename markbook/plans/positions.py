"""Numbers for rows that have no key but their place in a file.

Rows are numbered where they are read: by their place within the stretch of a file that a
task reads, plus the rows of the stretches before.  Only the counts, one row per stretch,
meet in one place; the lines themselves are neither moved nor sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markbook.plans.joins import small

_STRETCH = ("file", "_block")


def numbered_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``file, line_no, row_no, value``: the lines of text files, numbered from 0.

    ``line_no`` counts within a file, ``row_no`` through all files by their path.
    """
    options = {"pathGlobFilter": pattern} if pattern else {}
    lines = spark.read.text(path, **options).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    stretches = lines.groupBy(*_STRETCH).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy(*_STRETCH).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stretches.withColumn("_before", before).withColumn(
        "_file", F.min("_before").over(Window.partitionBy("file"))
    )
    placed = lines.join(small(offsets.drop("_rows")), list(_STRETCH))
    within = F.col("_id") - F.col("_first") + F.col("_before")
    return placed.select("file", (within - F.col("_file")).alias("line_no"), within.alias("row_no"), "value")


def zipped(left: DataFrame, right: DataFrame, on: str = "row_no") -> DataFrame:
    """Rows of two tables side by side by their number; an error if one has more rows.

    Columns other than the number must have names of their own.
    """
    both = left.withColumn("_left", F.lit(True)).join(right.withColumn("_right", F.lit(True)), on, "full")
    whole = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    alone = F.raise_error(F.concat(F.lit("rows without a partner, the first known at "), F.col(on).cast("string")))
    return both.where(F.when(whole, F.lit(True)).otherwise(alone.cast("boolean"))).drop("_left", "_right")
