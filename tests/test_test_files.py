from __future__ import annotations

import json
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from markbook.plans import positions
from markbook.sources import documents as docs
from markbook.sources import test_files as tf


def questions_of(spark, rows):
    """Rows of test id, number and text as questions."""
    return spark.createDataFrame(rows, "test_id string, question_no long, question_text string").select(
        "test_id", "question_no",
        F.concat(F.lit("q"), F.coalesce(F.col("question_no").cast("string"), F.lit("?"))).alias("question_id"),
        F.lit("short_answer").alias("question_type"), F.lit("writing").alias("subject_area"),
        F.lit(2).alias("difficulty_level"), "question_text", F.struct(F.lit("x").alias("answer")).alias("correct_answer"),
        F.struct(F.lit(1).alias("points_possible")).alias("scoring_rubric"), F.lit("not written").alias("other"),
    )


def metadata_of(spark, ids, total=1):
    rows = [(i, 2000, "Year 3", ["writing"], total) for i in ids]
    return spark.createDataFrame(
        rows, "test_id string, year int, grade_level string, subject_areas array<string>, total_questions int"
    )


def written(folder):
    return {f.name: json.loads(f.read_text()) for f in Path(folder).glob("*.json")}


ODD_TEXTS = ["plain", 'quotes " and \\', "line\nbreak\r", "é   😀", "]}", ',{"test_metadata":', "", " x" * 3000]


def test_one_file_per_test_and_back(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("big", i, f"{ODD_TEXTS[i % 8]} {i}") for i in range(400)]
    rows += [(f"t/{i % 7}?", i, ODD_TEXTS[i % 8]) for i in range(70)] + [("lost", 1, "of no test"), (None, 1, "x")]
    ids = ["big", "empty", *[f"t/{i}?" for i in range(7)], None]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tf.write_test_files(metadata_of(spark, ids, 10), questions_of(spark, rows).repartition(5), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = written(path)
    assert sorted(files) == sorted(["big.json", "empty.json", *[f"t%2F{i}%3F.json" for i in range(7)]])
    assert [q["question_text"] for q in files["big.json"]["questions"]] == [r[2] for r in rows[:400]]
    assert files["empty.json"]["questions"] == []
    assert files["t%2F3%3F.json"]["test_metadata"]["test_id"] == "t/3?"
    assert set(files["big.json"]["questions"][0]) == {
        "question_id", "question_type", "subject_area", "difficulty_level", "question_text", "correct_answer", "scoring_rubric",
    }
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    read, rejected = tf.read_test_files(spark, path)
    assert rejected.count() == 0
    back = {(r["test_id"], r["question_no"]): (r["question_text"], r["count_matches"]) for r in read.collect()}
    assert len(back) == 470
    assert all(back["big", i] == (rows[i][2], False) for i in range(400))
    assert back["t/2?", 3] == (ODD_TEXTS[23 % 8], True)
    whole = docs.flatten_questions(docs.parse_documents(docs.read_documents(spark, path)))
    assert whole.count() == 470


def test_a_folder_is_replaced_and_repeated_rows_have_an_order(spark, tmp_path):
    path = str(tmp_path / "out")
    tf.write_test_files(metadata_of(spark, ["old"]), questions_of(spark, [("old", 0, "x")]), path)
    rows = [("a", 2, "last"), ("a", 1, "second"), ("a", 1, "first"), ("a", None, "none")]
    tf.write_test_files(metadata_of(spark, ["a", "a"]).union(metadata_of(spark, ["a"], 9)), questions_of(spark, rows), path)
    files = written(path)
    assert list(files) == ["a.json"]
    assert [q["question_text"] for q in files["a.json"]["questions"]] == ["none", "first", "second", "last"]
    assert files["a.json"]["test_metadata"]["total_questions"] == 1
    tf.write_test_files(metadata_of(spark, ["a"]).where("false"), questions_of(spark, rows), path)
    assert written(path) == {}
    assert tf.read_test_files(spark, path)[0].count() == 0


def test_a_failed_write_leaves_the_old_folder(spark, tmp_path):
    path = str(tmp_path / "out")
    tf.write_test_files(metadata_of(spark, ["old"]), questions_of(spark, [("old", 0, "x")]), path)
    bad = questions_of(spark, [("a", i, "x") for i in range(20)]).withColumn(
        "question_text", F.when(F.col("question_no") == 13, F.raise_error(F.lit("no"))).otherwise(F.col("question_text"))
    )
    with pytest.raises(Exception, match="no"):
        tf.write_test_files(metadata_of(spark, ["a"]), bad, path)
    assert list(written(path)) == ["old.json"]


def test_documents_that_break_a_rule_are_rejected_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    questions = questions_of(spark, [("a", i, "x") for i in range(3)] + [("b", i, "y") for i in range(3)] + [("c", 0, "z")])
    level = F.when((F.col("test_id") == "b") & (F.col("question_no") == 1), 9).otherwise(2)
    tests = metadata_of(spark, ["a", "b", "c"], 3).withColumn("year", F.when(F.col("test_id") != "c", F.col("year")))
    tf.write_test_files(tests, questions.withColumn("difficulty_level", level), path)
    read, rejected = tf.read_test_files(spark, path)
    assert sorted((r["test_id"], r["question_no"], r["count_matches"]) for r in read.collect()) == [("a", i, True) for i in range(3)]
    assert sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["violations"]) for r in rejected.collect()) == [
        ("b.json", 2, ["question.difficulty_level: outside 1..5"]),
        ("c.json", 0, ["test_metadata.year: missing"]),
    ]


def batches(count, size=2000):
    yield pa.RecordBatch.from_pydict({"test_id": ["a", "b"], "kind": pa.array([0, 0], pa.int32()), "body": ["{}", "{}"]})
    for begin in range(0, count, size):
        body = [f'{{"question_id":"{i}","text":"{"word " * 20}"}}' for i in range(begin, min(begin + size, count))]
        yield pa.RecordBatch.from_pydict(
            {"test_id": ["b"] * len(body), "kind": pa.array([1] * len(body), pa.int32()), "body": body}
        )


def test_a_test_of_a_million_questions_takes_bounded_memory(tmp_path):
    folder = str(tmp_path / "out")
    tf.TestFileWriter(str(tmp_path / "first")).write(batches(10))  # modules that are loaded on first use do not count
    tracemalloc.start()
    done = tf.TestFileWriter(folder).write(batches(1_000_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(p.test_id, p.headed, p.questions) for p in done.pieces] == [("a", True, 0), ("b", True, 1_000_000)]
    assert tf._joined(folder, done.pieces[1:])
    size = (Path(folder) / "b.json").stat().st_size
    assert peak < 10_000_000 < 100_000_000 < size


def test_a_million_questions_come_back(spark, tmp_path):
    path = str(tmp_path / "out")
    number = F.col("id")
    questions = spark.range(1_000_000).select(
        F.lit("big").alias("test_id"), number.alias("question_no"), number.cast("string").alias("question_id"),
        F.lit("cloze").alias("question_type"), F.lit("writing").alias("subject_area"), F.lit(1).alias("difficulty_level"),
        F.md5(number.cast("string")).alias("question_text"), F.struct(F.lit("x").alias("answer")).alias("correct_answer"),
        F.struct(F.lit(1).alias("points_possible")).alias("scoring_rubric"),
    )
    tf.write_test_files(metadata_of(spark, ["big"], 1_000_000), questions, path)
    read, rejected = tf.read_test_files(spark, path)
    assert rejected.count() == 0
    told = read.select(
        F.count("*"),
        F.count_if("count_matches"),
        F.count_if(F.col("question_id") == F.col("question_no").cast("string")),
        F.count_if(F.col("question_text") == F.md5(F.col("question_no").cast("string"))),
    ).head()
    assert list(told) == [1_000_000] * 4


def test_lines_are_numbered_through_files_and_splits(spark, tmp_path):
    lines = [[f"{'x' * (i % 50)}{i}" for i in range(n)] for n in (3000, 1, 0, 777)]
    for name, part in zip("abcd", lines, strict=True):
        (tmp_path / f"{name}.txt").write_text("".join(f"{x}\n" for x in part))
    for key, value in (("maxPartitionBytes", "4096"), ("openCostInBytes", "0")):
        spark.conf.set(f"spark.sql.files.{key}", value)
    try:
        got = positions.numbered_lines(spark, str(tmp_path))
        rows = sorted((r["row_no"], r["file"][-5:], r["line_no"], r["value"]) for r in got.collect())
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")
    flat = [(f"{name}.txt", i, x) for name, part in zip("abcd", lines, strict=True) for i, x in enumerate(part)]
    assert rows == [(n, *row) for n, row in enumerate(flat)]


def test_rows_without_a_partner_are_an_error(spark):
    left = spark.range(10).select(F.col("id").alias("row_no"), F.col("id").alias("a"))
    right = spark.range(9).select(F.col("id").alias("row_no"), F.col("id").alias("b"))
    assert sorted(map(tuple, positions.zipped(left.where("a < 9"), right).collect())) == [(i, i, i) for i in range(9)]
    for pair in ((left, right), (right, left)):
        with pytest.raises(Exception, match="without a partner"):
            positions.zipped(*pair).collect()
