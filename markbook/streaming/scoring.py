"""Scoring responses as they arrive.

Scoring a response needs its question and nothing else, so the batch operator
runs on a stream unchanged: the stream of responses is joined to the static
question bank, no state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from markbook.config import DEFAULT, Config
from markbook.operators.scoring import score_responses

RESPONSE_SCHEMA = "student_id string, test_id string, question_id string, response string"


def read_response_stream(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON responses from a folder that grows."""
    return spark.readStream.schema(RESPONSE_SCHEMA).json(path)


def score_stream(bank: DataFrame, responses: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Item scores of a stream of responses; ``bank`` comes from ``prepare_bank``."""
    return score_responses(bank, responses, cfg)


def progress_folder(spark: SparkSession, name: str) -> str:
    """Folder for a stream's progress below the cluster's shared checkpoint folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{shared.rstrip('/')}/{name}"


def write_scores(scores: DataFrame, path: str, name: str = "item_scores") -> StreamingQuery:
    """Append scores to a parquet table, all that is there now, exactly once."""
    return (
        scores.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", progress_folder(scores.sparkSession, name))
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
