"""Cutting lineage where recomputing would change or repeat costly results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where it is not set, a session on a single machine (as in tests) gets a folder of
    its own; on a cluster that is an error, since a local folder would not be shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="markbook-stage-")
    return _own[context.applicationId]


def stage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder and read them from there.

    For rows a model made: computed again after a lost executor, or for a second
    use, they would differ.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
