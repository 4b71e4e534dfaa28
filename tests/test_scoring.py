from __future__ import annotations

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from markbook.config import DEFAULT, Config
from markbook.functions.stemming import stem
from markbook.operators import scoring as sc
from markbook.plans.joins import first_match, lookup_join, salted_join
from markbook.sources import documents as docs
from tests.test_similarity import cosine_twin
from tests.test_text import tokens_twin

REEF = (
    "A coral reef is busy after sunrise. Small fish swim out and eat algae. "
    "Then the reef changes before midnight. Crabs and eels leave their holes to hunt, because it is dark and quiet."
)


def bank_of(spark, *documents):
    raw = spark.createDataFrame([(json.dumps(d),) for d in documents], "document string")
    return docs.flatten_questions(docs.parse_documents(raw))


def responses_of(spark, rows):
    return spark.createDataFrame(rows, "student_id string, test_id string, question_id string, response string")


def test_whole_test(spark, sample):
    questions = bank_of(spark, sample)
    responses = responses_of(
        spark,
        [
            ("ann", "REEF", "reef-food", "D"),
            ("ann", "REEF", "reef-word", "Awake at night!"),
            ("ann", "REEF", "reef-essay", REEF),
            ("ann", "REEF", "reef-none", "to no question"),
            ("bob", "REEF", "reef-word", "moves and hunts during a night"),
            ("eve", "REEF", "reef-food", "Its algae"),
            ("eve", "REEF", "reef-verb", "a"),
        ],
    )
    empty_handed = spark.createDataFrame([("zoe", "REEF"), ("ann", "REEF")], "student_id string, test_id string")
    items = sc.score_tests(questions, responses, sittings=empty_handed).cache()
    got = {(r.student_id, r.question_id): r for r in items.collect()}
    assert len(got) == 16
    assert (got["ann", "reef-food"].points_earned, got["ann", "reef-food"].confidence) == (3, 1.0)
    assert (got["ann", "reef-word"].points_earned, got["ann", "reef-word"].confidence) == (2, 0.95)
    assert got["bob", "reef-word"].feedback != sc.EXACT  # the words are right, their order is not
    assert got["bob", "reef-food"].response == "" and got["bob", "reef-food"].points_earned == 0
    # The first of A-D anywhere in longer text counts, here the A of ALGAE.
    assert (got["eve", "reef-food"].student_answer, got["eve", "reef-food"].points_earned) == ("A", 0)
    assert got["eve", "reef-food"].feedback == "The correct answer is D. The rocks are covered with algae."
    assert got["eve", "reef-verb"].points_earned == 2
    essay = got["ann", "reef-essay"]
    assert (essay.analysis.word_count, essay.analysis.sentence_count) == (len(tokens_twin(REEF)), 4)
    assert essay.analysis.has_content
    overall = 0.6 * 0.8 + 0.3 * essay.analysis.language_quality + 0.1 * min(1, essay.analysis.word_count / 30)
    assert essay.points_earned == (5 - 1 if overall >= 0.70 else 5 - 2) and essay.is_correct
    blank = got["bob", "reef-essay"]
    assert blank.points_earned == 0 and not blank.analysis.has_content
    assert blank.feedback == " ".join([sc.UNDERDEVELOPED, sc.WRITE_MORE, sc.CHECK_SPELLING, sc.OFF_TOPIC])
    assert all(got["zoe", q["question_id"]].points_earned == 0 for q in sample["questions"])

    rolled = sc.roll_up(items).cache()
    scores = {r.student_id: r for r in sc.test_scores(rolled).collect()}
    assert (scores["ann"].total_points_earned, scores["ann"].total_points_possible) == (9, 13)
    assert (scores["ann"].overall_grade, scores["zoe"].overall_grade) == ("D", "F")
    advice = {r.student_id: r.recommendations for r in sc.recommendations(rolled).collect()}
    assert advice["zoe"] == [sc.OVERALL_LOW, *(sc.SUBJECT_ADVICE[q["subject_area"]] for q in sample["questions"])]
    levels = {(r.student_id, r.level, r.category): r for r in rolled.collect()}
    assert levels["eve", "subject", "language_conventions"].percentage == 100.0
    assert levels["ann", "question_type", "multiple_choice"].correct == 1


def short_twin(answer, variations, response):
    def norm(t):
        kept = "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower())
        return " ".join(stem(w) for w in kept.split() if w not in DEFAULT.stop_words)

    if norm(response) == norm(answer):
        return 2, True, 1.0
    if norm(response) in [norm(v) for v in variations]:
        return 2, True, 0.95
    ratio = SequenceMatcher(None, response.lower(), answer.lower()).ratio()
    alike = max(cosine_twin(response, answer) or 0.0, ratio)
    points = 2 if alike >= 0.8 else 1 if alike >= 0.6 else 0
    return points, points == 2, alike


def test_short_answers_equal_plain_python(spark, sample):
    rng = random.Random(11)
    words = "it hunts moves during the night awake at moving hunting nights sleeps by daylight animal is".split()
    key = sample["questions"][2]["correct_answer"]
    rows = [("s%d" % i, "REEF", "reef-word", " ".join(rng.choices(words, k=rng.randint(0, 7)))) for i in range(200)]
    rows += [("x1", "REEF", "reef-word", "the"), ("x2", "REEF", "reef-word", "Night animals!")]
    rows += [("x3", "REEF", "reef-word", "kind of"), ("x4", "REEF", "reef-word", "it hunts and moves in the night")]
    bank = sc.prepare_bank(bank_of(spark, sample))
    got = {r.student_id: r for r in sc.score_responses(bank, responses_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    for student, _, _, response in rows:
        points, right, confidence = short_twin(key["answer"], key["acceptable_variations"], response)
        r = got[student]
        assert (r.points_earned, r.is_correct) == (points, right), response
        assert r.confidence == pytest.approx(confidence)


def changed(sample, place, part, **values):
    document = json.loads(json.dumps(sample))
    document["questions"][place][part].update(values)
    return document


def test_stop_word_answer_equals_an_empty_response(spark, sample):
    bank = sc.prepare_bank(bank_of(spark, changed(sample, 2, "correct_answer", answer="the")))
    got = sc.score_responses(bank, responses_of(spark, [("s", "REEF", "reef-word", "")])).first()
    assert (got.points_earned, got.feedback) == (2, sc.EXACT)


def test_points_may_be_capped(spark, sample):
    bank = sc.prepare_bank(bank_of(spark, changed(sample, 2, "scoring_rubric", points_possible=1)))
    answer = responses_of(spark, [("s", "REEF", "reef-word", "night animal")])
    assert sc.score_responses(bank, answer).first().points_earned == 2
    assert sc.score_responses(bank, answer, Config(cap_to_possible=True)).first().points_earned == 1


def test_rubric_without_criteria_is_an_error_row(spark, sample):
    bank = sc.prepare_bank(bank_of(spark, changed(sample, 0, "scoring_rubric", scoring_criteria=[])))
    got = sc.score_responses(bank, responses_of(spark, [("s", "REEF", "reef-essay", REEF)])).first()
    assert got.points_earned is None and got.error == "rubric without scoring criteria"


def test_relevant_responses_never_reach_full_marks(spark):
    """Content is .8 or .2 and language at most .8, so the top band stays empty."""
    schema = "has_content boolean, word_count int, content_score double, language_quality double"
    rows = [
        (True, w, 0.8, (a + b + c) / 3)
        for w in (1, 10, 30, 100)
        for a in (0.5, 0.8)
        for b in (0.5, 0.8)
        for c in (0.5, 0.8)
    ]
    df = spark.createDataFrame([(r,) for r in rows], f"a struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    overall = sc.extended_overall(F.col("a"))
    got = df.select(overall.alias("o"), sc.extended_points(F.col("a.has_content"), overall, F.lit(4)).alias("p")).collect()
    assert {r.p for r in got} == {2, 3} and all(0.63 <= round(r.o, 9) <= 0.82 for r in got)


def test_grades_are_monotone(spark):
    df = spark.range(0, 101).select(F.col("id").alias("p"), sc.letter_grade(F.col("id")).alias("g"))
    letters = [r.g for r in df.orderBy("p").collect()]
    assert letters == sorted(letters, reverse=True)
    assert (letters[59], letters[60], letters[70], letters[80], letters[90]) == ("F", "D", "C", "B", "A")


def test_salts_meet_every_pair_once(spark):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    lookup = lookup.unionByName(lookup.filter("k in (0, 7)").withColumn("v", F.lit(-1)))
    for how in ("inner", "left"):
        plain = sorted(map(tuple, facts.join(lookup, ["k"], how).collect()), key=str)
        for got in (salted_join(facts, lookup, ["k"], 7, how), lookup_join(facts, lookup, ["k"], how)):
            assert sorted(map(tuple, got.collect()), key=str) == plain


def test_hot_question_scores_as_any_other(spark, sample):
    """A third of all responses on one question, joined by shuffle and by broadcast."""
    rows = [(f"s{i}", "REEF", "reef-food" if i % 3 else "reef-word", "D") for i in range(600)]
    questions, responses = bank_of(spark, sample), responses_of(spark, rows)
    pick = lambda df: sorted(map(tuple, df.select("student_id", "question_id", "points_earned").collect()))
    broadcast = pick(sc.score_tests(questions, responses))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = pick(sc.score_tests(questions, responses))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert broadcast == shuffled and len(broadcast) == 600 * 4
    assert sum(points for _, q, points in broadcast if q == "reef-food") == 400 * 3


def test_bank_is_prepared_without_running_a_job(spark, sample):
    questions = bank_of(spark, sample)
    spark.sparkContext.setJobGroup("bank", "none expected")
    try:
        sc.prepare_bank(questions)
        sc.score_tests(questions, responses_of(spark, [("s", "REEF", "reef-food", "D")]))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("bank")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_first_match_and_duplicate_responses(spark, sample):
    rows = [("a", 2, "late"), ("a", 1, "early"), ("a", None, "never"), ("b", 5, "only"), ("c", None, "placeless")]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    first = sorted((r.k, r.v) for r in first_match(df, ["k"], "n").collect())
    assert first == [("a", "early"), ("b", "only"), ("c", "placeless")]
    doubled = responses_of(spark, [("s", "REEF", "reef-food", x) for x in ("A", "D", None)])
    items = sc.score_tests(bank_of(spark, sample), doubled).filter("question_id = 'reef-food'").collect()
    assert [(r.response, r.points_earned) for r in items] == [("D", 3)]
