"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.plans import stage as stage_module
from markbook.session import attach

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; workers get the package along with it."""
    return attach(spark).read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{stage_module.shared_folder(spark)}/markbook-{uuid.uuid4().hex}"


#: Rows that Python workers get at a time in staged steps: whole texts, sets and blocks are wide.
BATCH_ROWS = 500


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What runs meanwhile hands Arrow batches of so many rows at most to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame) -> DataFrame:
    """Write rows once to the shared folder and read them from there.

    Cuts the lineage: a lost executor repeats no more than what came after.
    """
    folder = new_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_held: dict[Hashable, Any] = {}


def held(owner: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between batches: the state of one operator at a time.

    Workers outlive their tasks; the state of the operator before goes when another one
    starts, so the stages of a pipeline do not add up in memory.
    """
    if owner not in _held:
        _held.clear()
        _held[owner] = make()
    return _held[owner]


#: Up to so many ids are sent to every executor (some 20 MB); beyond, rows are joined by shuffle.
BROADCAST_IDS = 1_000_000


def by_ids(rows: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """Semi or anti join of wide rows with a list of ids, which is staged and counted first.

    A null id matches nothing.  A short list is broadcast, so texts stay where they
    are; a long one is joined by shuffle, with the same rows.
    """
    listed = stage(ids.select(id_col).where(F.col(id_col).isNotNull()).distinct())
    few = listed.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(listed) if few else listed, id_col, how)


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def salted_join(
    rows: DataFrame, keyed: DataFrame, keys: list[str], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join rows with a table of one narrow row per key; hot keys are dealt to several tasks.

    Rows carry a salt of their content, the other table is repeated once per salt,
    whatever the sizes: a key of a third of all rows is split ``salts`` ways.
    """
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    repeated = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(repeated, [*keys, "_salt"], how).drop("_salt")
