"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

All of it is DataFrame operations.  One scan of the texts leaves a narrow
signature per row.  Rows whose length is unique leave first, then those whose
prefix hash is unique within their length; only rows of the groups that survive
both are grouped by the full hash, so the wide hashes of unique texts never move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import WHITE_SPACE, salted_join, stage, text_or_empty

PREFIX_CHARS = 64


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after each run of ASCII white space became one
    space; the smallest id of equal texts stays.  Null text counts as empty, and
    empty texts equal one another.  A null id never stays while the group has
    another; rows that repeat an id and a text get the same answer each.  Other
    columns of the input are ignored; an empty table gives no rows.

    Counting is pre-aggregated per task, so a text that a third of all rows share
    costs one row per task; the joins back have one row per group on their other
    side and salt the rows.
    """
    text = F.regexp_replace(text_or_empty(text_col), WHITE_SPACE, " ")
    signed = stage(
        docs.select(F.col(id_col).alias("doc_id"), text.alias("body")).select(
            "doc_id",
            F.length("body").alias("length"),
            F.xxhash64(F.substring("body", 1, prefix_chars)).alias("prefix"),
            F.sha2("body", 256).alias("text_sha256"),
        )
    )
    rows = signed
    for known in (["length"], ["length", "prefix"]):
        repeated = rows.groupBy(*known).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*known)
        rows = salted_join(rows, repeated, known, "left_semi")
    groups = (
        rows.groupBy("length", "prefix", "text_sha256")
        .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("text_sha256", "first", "n")
    )
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return salted_join(signed, groups, ["text_sha256"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
