"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from markbook.llm import (
    collocations,
    cross_polytope,
    decontaminate,
    exact_dedup,
    html_text,
    language,
    near_dedup,
    packing,
    passages,
    periodic,
    pii,
    quality,
    suffix_dedup,
    twins,
)
from markbook.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register


@query("op3_personal_data", twins.PERSONAL_DATA)
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text."""
    return pii.digest(pii.find_personal_data(table(spark, folder, "documents")))


@query("op8_exact_dedup", twins.EXACT_DEDUP)
def exact(spark: SparkSession, folder: str) -> DataFrame:
    """Exact copies, up to white space, over all documents."""
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@query("op7_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"))


@query("op10_decontamination", twins.DECONTAMINATION)
def decontaminated(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents hold windows of benchmark items."""
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.digest(found)


@query("op4_language_id")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learnt from the rows that are not held out."""
    return language.predict_languages(table(spark, folder, "documents"))


@query("op9_quality")
def scored(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of every document, learnt from the labels that are not held out."""
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_near_dedup")
def near(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates over all documents."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query("op5_main_text")
def main_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, folder, "pages"))


@query("op2_suffix_dedup")
def repeats_removed(spark: SparkSession, folder: str) -> DataFrame:
    """What repeats of 50 bytes leave of every document."""
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, folder, "documents")))


@query("op1_passages")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Fuzzy passages that documents repeat from others."""
    found = passages.find_passages(table(spark, folder, "documents"))
    return found.withColumn("n_words", F.col("stop") - F.col("start"))


@query("op11_periodic_runs")
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of which end in a planted period."""
    docs = periodic.with_planted_runs(table(spark, folder, "documents"))
    return periodic.digest(periodic.find_runs(docs))


@query("op12_nearest_neighbours")
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return cross_polytope.nearest_neighbours(table(spark, folder, "embeddings"), cross_polytope.every())


@query("op13_collocations", twins.COLLOCATIONS)
def collocated(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of each language."""
    return collocations.collocations(table(spark, folder, "documents"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
