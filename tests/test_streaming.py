from __future__ import annotations

import json

from markbook.operators import scoring as sc
from markbook.sources import documents as docs
from markbook.streaming import scoring as stream


def test_stream_equals_batch(spark, tmp_path, sample):
    raw = spark.createDataFrame([(json.dumps(sample),)], "document string")
    bank = sc.prepare_bank(docs.flatten_questions(docs.parse_documents(raw)))
    rows = [
        ("s1", "REEF", "reef-food", "D"),
        ("s1", "REEF", "reef-word", "awake at night"),
        ("s2", "REEF", "reef-word", "moving by night"),
    ]
    responses = spark.createDataFrame(rows, stream.RESPONSE_SCHEMA)
    responses.limit(2).write.json(str(tmp_path / "in" / "a"))
    folder = str(tmp_path / "in" / "*")
    out = str(tmp_path / "out")
    stream.write_scores(stream.score_stream(bank, stream.read_response_stream(spark, folder)), out).awaitTermination(120)
    first = spark.read.parquet(out).count()
    responses.subtract(responses.limit(2)).write.json(str(tmp_path / "in" / "b"))
    stream.write_scores(stream.score_stream(bank, stream.read_response_stream(spark, folder)), out).awaitTermination(120)
    columns = ["student_id", "question_id", "points_earned", "is_correct", "feedback"]
    got = sorted(map(tuple, spark.read.parquet(out).select(columns).collect()))
    want = sorted(map(tuple, sc.score_responses(bank, responses).select(columns).collect()))
    assert first == 2 and got == want
