"""A corpus from raw documents to packed sequences, stage by stage.

Every stage takes ``(spark, docs, folder)`` and returns a DataFrame, which is written as
Parquet in the folder that all executors share and read again as the next stage's
documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.llm import decontaminate, exact_dedup, language, near_dedup, packing
from markbook.llm.common import by_ids, stage, table
from markbook.session import attach


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language can be told; texts without a letter go."""
    held = F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))
    predict = language.prediction(attach(spark), language.sample_words(docs.where(~held)))
    return docs.where(predict("text")["lang_pred"] != language.UNKNOWN)


def one_of_equal(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the document of the smallest id; documents with a null id stay."""
    attach(spark)
    return by_ids(docs, exact_dedup.exact_duplicates(docs).where("NOT kept"), "left_anti")


def one_of_near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of near duplicates the document of the smallest id; documents with a null id stay."""
    attach(spark)
    return by_ids(docs, near_dedup.near_duplicates(docs).where("NOT kept"), "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    found = decontaminate.find_contamination(docs, table(spark, folder, "benchmark"))
    return by_ids(docs, found.where("contaminated"), "left_anti")


def sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents in packed sequences."""
    attach(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equal),
    ("near_dedup", one_of_near),
    ("decontamination", without_benchmark),
    ("packing", sequences),
]

# Near duplicates and tokens are beyond SQL; tests/llm holds the pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on the table ``documents``; what is between them is staged."""
    docs = table(spark, folder, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
