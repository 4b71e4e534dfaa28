"""Join shapes used by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markbook.plans.stage import stage

# Tasks that share the rows of one key where a plan cannot be changed as it runs.
STREAM_SALTS = 16
# Narrow rows up to which a table is sent to every executor.
SMALL = 1_000_000


def lookup_join(facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join facts to a lookup table of one or few rows per key, whatever its size.

    Both sides are shuffled by the key, and adaptive execution decides by what the
    shuffles measured: a small lookup becomes a broadcast, partitions of hot keys are
    split.  Streams run without it, so there every key is salted.
    """
    if facts.isStreaming:
        return salted_join(facts, lookup, on, STREAM_SALTS, how)
    return facts.join(lookup, on, how)


def salted_join(facts: DataFrame, lookup: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """Shuffled join in which the facts of a key are dealt to ``salts`` tasks.

    A fact takes its salt by the hash of its own columns, so a task run again deals
    rows out alike; lookup rows are repeated once per salt.  Each pair meets once.
    """
    own = [F.col(f"`{name}`") for name, kind in facts.dtypes if not kind.startswith("map")]
    dealt = facts.withColumn("__salt", F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "__salt"], how).drop("__salt")


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """Rows that are staged and counted: sent to every executor if there are few, joined by shuffle if not."""
    staged = stage(df)
    return F.broadcast(staged) if staged.count() <= most else staged


def first_match(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, rows without an order last.

    A ranking whose first place alone is wanted is cut per task before the shuffle,
    and leaves rows dealt out and sorted by the keys, as a join on them needs.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last()))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")
