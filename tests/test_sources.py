from __future__ import annotations

import copy
import json

import pytest
from pyspark.sql import functions as F

from markbook.sources import documents as docs
from markbook.sources import sinks
from markbook.sources.tables import spread


@pytest.fixture
def folder(tmp_path, sample):
    broken = copy.deepcopy(sample)
    broken["test_metadata"]["grade_level"] = "Year 4"
    broken["questions"][1]["difficulty_level"] = 6
    del broken["questions"][2]["correct_answer"]
    broken["questions"][3]["tags"] = ["verb", 1]
    (tmp_path / "good.json").write_text(json.dumps(sample, indent=2))
    (tmp_path / "bad.json").write_text(json.dumps(broken))
    (tmp_path / "cut.json").write_text('{"test_metadata": ')
    (tmp_path / "notes.txt").write_text("not a document")
    return str(tmp_path)


def test_documents_are_checked_and_flattened(spark, folder):
    raw = docs.read_documents(spark, folder)
    assert raw.count() == 3
    rejected = {
        r.file.rsplit("/", 1)[1]: r.violations for r in docs.rejected_documents(raw).collect()
    }
    assert sorted(rejected) == ["bad.json", "cut.json"]
    assert rejected["cut.json"] == ["not JSON"]
    assert sorted(rejected["bad.json"]) == [
        "questions[1].difficulty_level: outside 1..5",
        "questions[2].correct_answer: missing",
        "questions[3].tags[1]: not a string",
        "test_metadata.grade_level: not allowed",
    ]
    parsed = docs.parse_documents(raw)
    assert [r.count_matches for r in parsed.collect()] == [False]
    rows = docs.flatten_questions(parsed).orderBy("question_no").collect()
    names = ["reef-essay", "reef-food", "reef-word", "reef-verb"]
    assert [(r.question_no, r.question_id) for r in rows] == list(enumerate(names))
    assert rows[1].correct_answer.answer == "D"


@pytest.mark.parametrize(
    "change, expected",
    [
        (lambda d: d["test_metadata"].update(year=2031.0), []),
        (lambda d: d["test_metadata"].update(year=2031.5), ["test_metadata.year: not an integer"]),
        (lambda d: d["test_metadata"].update(year=True), ["test_metadata.year: not an integer"]),
        (lambda d: d["test_metadata"].update(year=None), ["test_metadata.year: not an integer"]),
        (lambda d: d["test_metadata"].pop("year"), ["test_metadata.year: missing"]),
        (lambda d: d.update(extra=1), []),
        (lambda d: d.update(questions={}), ["questions: not an array"]),
        (lambda d: d["questions"][1].pop("learning_objective"), []),
        (lambda d: d["questions"][0].update(stimulus=None), ["questions[0].stimulus: not an object"]),
        (
            lambda d: d["questions"][1]["options"][2].pop("text"),
            ["questions[1].options[2].text: missing"],
        ),
        (
            lambda d: d["questions"][0]["scoring_rubric"].pop("points_possible"),
            ["questions[0].scoring_rubric.points_possible: missing"],
        ),
    ],
)
def test_single_rules(spark, sample, change, expected):
    document = copy.deepcopy(sample)
    change(document)
    df = spark.createDataFrame([(json.dumps(document),)], "document string")
    assert docs.with_violations(df).first().violations == expected


def test_responses_become_rows(spark, tmp_path):
    (tmp_path / "s1.json").write_text('{"reef-food": "B", "reef-word": "line\\nbreak"}')
    (tmp_path / "s2.json").write_text("{}")
    rows = docs.read_responses(spark, str(tmp_path), "REEF").orderBy("question_id").collect()
    assert [(r.student_id, r.test_id, r.question_id, r.response) for r in rows] == [
        ("s1", "REEF", "reef-food", "B"),
        ("s1", "REEF", "reef-word", "line\nbreak"),
    ]
    files = docs.read_response_files(spark, str(tmp_path), "REEF")
    assert sorted(map(tuple, docs.sittings_of(files).collect())) == [("s1", "REEF"), ("s2", "REEF")]


def test_unreadable_responses_are_told(spark, tmp_path):
    for name, text in (("ok", '{"a": "b"}'), ("cut", '{"a": '), ("list", '["a"]'), ("none", "null")):
        (tmp_path / f"{name}.json").write_text(text)
    files = docs.read_response_files(spark, str(tmp_path), "REEF")
    bad = docs.rejected_responses(files)
    assert sorted(r.student_id for r in bad.collect()) == ["cut", "list", "none"]
    with pytest.raises(Exception, match="not a response map"):
        docs.read_responses(spark, str(tmp_path), "REEF").collect()
    good = docs.explode_responses(files.join(bad.select("student_id"), "student_id", "left_anti"))
    assert [(r.question_id, r.response) for r in good.collect()] == [("a", "b")]


def test_integers_may_be_written_as_decimals(spark, sample):
    document = copy.deepcopy(sample)
    document["test_metadata"]["year"] = 2031.0
    document["questions"][1]["difficulty_level"] = 2.0
    document["questions"][1]["scoring_rubric"]["points_possible"] = 1e0
    raw = spark.createDataFrame([(json.dumps(document),)], "document string")
    row = docs.flatten_questions(docs.parse_documents(raw)).where("question_id = 'reef-food'").first()
    assert (row.test_metadata.year, row.difficulty_level, row.scoring_rubric.points_possible) == (2031, 2, 1)


def test_jsonl_round_trip_and_malformed_line(spark, tmp_path):
    rows = [("i", "", "o", "answer_generation", "writing", None, "cloze")]
    df = spark.createDataFrame(rows, docs.EXAMPLE_SCHEMA).withColumn("split", F.lit("train"))
    sinks.write_jsonl(df, str(tmp_path / "out"), "split")
    back = docs.read_jsonl(spark, str(tmp_path / "out" / "split=train"))
    assert [tuple(r) for r in back.collect()] == rows
    (tmp_path / "bad.jsonl").write_text('{"instruction": "a"}\n{oops\n')
    with pytest.raises(Exception):
        docs.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_spread_only_deals_out_small_scans(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(8).write.option("maxRecordsPerFile", 50).parquet(str(tmp_path / "many"))
    assert spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == 4
    many = spark.read.option("openCostInBytes", "0").parquet(str(tmp_path / "many"))
    wide = many.repartition(9)
    assert spread(wide) is wide
