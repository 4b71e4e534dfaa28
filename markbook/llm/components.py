"""Connected components of a large graph by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import salted_join, stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    larger = salted_join(both.where("b > a"), least, ["a"])
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    smaller = salted_join(edges, least, ["a"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; a component is named by its smallest node.

    Links may repeat, run either way, or join a node with itself; a link with a null
    end is none.  Each round leaves fewer distinct targets and the rounds end when
    nothing changes, after some log of the largest component.  The state between
    rounds is a table in the shared folder; only its count and checksum reach the
    driver.
    """
    own = links.where("a IS NOT NULL AND b IS NOT NULL")
    # From the larger to the smaller node.
    edges = stage(
        own.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _state(edges)
    while before[0]:
        edges = stage(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == before:
            break
        before = after
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.unionByName(roots)
