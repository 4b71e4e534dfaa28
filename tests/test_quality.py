from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from markbook.functions import text as tx
from markbook.operators import quality as q
from markbook.sources.documents import QUESTION_FIELDS
from tests.test_text import sentences_twin, syllables_twin, tokens_twin


def frame(spark, questions):
    schema = f"struct<{QUESTION_FIELDS}>"
    raw = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(questions)], "i int, j string")
    return raw.select("i", F.from_json("j", schema).alias("x")).select("i", "x.*")


def grade(text):
    words, sentences = tokens_twin(text), sentences_twin(text)
    if not words or not sentences:
        return 0.0
    total = sum(syllables_twin(w) for w in words)
    return max(0.0, 0.39 * len(words) / sentences + 11.8 * total / len(words) - 15.59)


def appropriate(text):
    n = len(tokens_twin(text))
    return 2 <= grade(text) <= 4 and n / max(1, sentences_twin(text)) <= 15 and n <= 200


def evaluation_twin(x):
    """validity, validation score, alignment, rubric score, topic score, overall."""
    text = x.get("question_text") or ""
    key, rubric = x.get("correct_answer"), x.get("scoring_rubric")
    missing = [f for f in ("question_text", "correct_answer", "scoring_rubric") if not x.get(f)]
    ok = appropriate(text)
    if missing:
        valid, score = False, 0.0
    else:
        valid = not (x.get("question_type") == "multiple_choice" and len(x.get("options") or []) < 2)
        score = 1 - (0 if ok else 0.3) + (0.1 if x.get("learning_objective") else 0)
        score += 0.1 if x.get("tags") else 0
        score -= 0 if key.get("explanation") else 0.2
        score = max(0, min(1, score))
    low, g = text.lower(), grade(text)
    base = 1 if g <= 2 else 2 if g <= 3 else 3 if g <= 4 else 4 if g <= 5 else 5
    flags = sum(any(w in low for w in ws) for ws in tx.INDICATORS.values())
    estimate = base + 0.5 * flags
    estimate += {"multiple_choice": 0, "short_answer": 0.5, "extended_response": 1, "cloze": 0.3}.get(x.get("question_type"), 0.5)
    estimate = min(5, max(1, estimate))
    stated = x.get("difficulty_level")
    align = 1 - abs((3 if stated is None else stated) - estimate) / 5
    if not rubric:
        rub = 0.0
    else:
        rub = 1 - (0.3 if rubric.get("points_possible") is None else 0)
        criteria = rubric.get("scoring_criteria")
        if criteria is None:
            rub -= 0.5
        elif not criteria:
            rub -= 0.4
        else:
            rub -= 0.1 * sum(not (c.get("criteria") or "").strip() for c in criteria)
            covered = {c.get("points") for c in criteria if c.get("points") is not None}
            rub -= 0 if (rubric.get("points_possible") or 0) in covered else 0.2
            rub -= 0 if 0 in covered else 0.1
        rub = max(0, rub)
    topic = 1 - 0.3 * sum(t in low for t in tx.UNSUITABLE_TOPICS)
    topic += 0.2 if any(t in low for t in tx.SUITABLE_TOPICS) else 0
    topic = max(0, min(1, topic - (0 if ok else 0.2)))
    overall = 0.3 * score + 0.2 * (1 if ok else 0.5) + 0.2 * topic + 0.15 * align + 0.15 * rub
    return valid, score, align, rub, topic, overall


def random_questions(n):
    rng = random.Random(3)
    words = "why how the dog family explain scary and compare school judge river runs fast a big tree because".split()
    made = []
    for _ in range(n):
        x = {}
        if rng.random() < 0.9:
            x["question_text"] = " ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["?", ".", ""])
        if rng.random() < 0.9:
            x["correct_answer"] = {"answer": "a"} | ({"explanation": rng.choice(["", "e"])} if rng.random() < 0.5 else {})
        if rng.random() < 0.9:
            r = {}
            if rng.random() < 0.8:
                r["points_possible"] = rng.randint(0, 3)
            if rng.random() < 0.8:
                r["scoring_criteria"] = [
                    {"points": rng.randint(0, 3)} | ({"criteria": rng.choice([" ", "c"])} if rng.random() < 0.8 else {})
                    for _ in range(rng.randint(0, 4))
                ]
            x["scoring_rubric"] = r
        x["question_type"] = rng.choice(["multiple_choice", "short_answer", "extended_response", "cloze", "essay"])
        if rng.random() < 0.7:
            x["options"] = [{"option_id": "A", "text": "t"}] * rng.randint(0, 3)
        if rng.random() < 0.7:
            x["difficulty_level"] = rng.randint(1, 5)
        if rng.random() < 0.5:
            x["tags"] = rng.choice([[], ["t"]])
        if rng.random() < 0.5:
            x["learning_objective"] = rng.choice(["", "o"])
        made.append(x)
    return made


def test_evaluation_equals_plain_python(spark):
    made = random_questions(120)
    rows = q.evaluate_questions(frame(spark, made), ("i",)).orderBy("i").collect()
    for row, x in zip(rows, made):
        got = (
            row.validation_result.is_valid,
            row.validation_result.quality_score,
            row.difficulty_assessment.alignment_score,
            row.rubric_quality.quality_score,
            row.appropriateness_score,
            row.quality_score,
        )
        assert got == pytest.approx(evaluation_twin(x)), x
        assert row.question_id == "unknown"


def test_validation_messages(spark):
    text = "What color is the sky?"
    cases = [
        {"question_text": text, "correct_answer": {"answer": "blue"}, "scoring_rubric": {"points_possible": 1}},
        {"question_text": text},
        {
            "question_text": text,
            "question_type": "multiple_choice",
            "options": [{"option_id": "A", "text": "x"}],
            "correct_answer": {"answer": "A"},
            "scoring_rubric": {"points_possible": 1},
            "stimulus": {"type": "text", "content": "Unbelievably complicated vocabulary."},
        },
    ]
    rows = q.validate_questions(frame(spark, cases)).orderBy("i").collect()
    assert rows[0].is_valid and rows[0].warnings == [tx.TOO_SIMPLE]
    assert rows[0].validation_score == pytest.approx(0.5)
    assert not rows[1].is_valid and rows[1].validation_score == 0
    assert rows[1].errors == ["Missing required field: correct_answer", "Missing required field: scoring_rubric"]
    assert rows[2].errors == [q.FEW_OPTIONS] and rows[2].validation_score == pytest.approx(0.5)
    assert rows[2].warnings == [tx.TOO_SIMPLE, f"Stimulus: {tx.TOO_COMPLEX}"]


def test_rubric_issues(spark):
    full = {"points_possible": 2, "scoring_criteria": [{"points": p, "criteria": "c"} for p in (2, 1, 0)]}
    cases = [
        {"scoring_rubric": full},
        {},
        {"scoring_rubric": {}},
        {"scoring_rubric": {"points_possible": 2, "scoring_criteria": [{"points": 1, "criteria": "x"}]}},
        {"scoring_rubric": {"scoring_criteria": []}},
    ]
    rows = [
        r[0] for r in frame(spark, cases).orderBy("i").select(q.rubric_quality(F.col("scoring_rubric"))).collect()
    ]
    assert (rows[0].quality_score, rows[0].issues, rows[0].is_complete) == (1.0, [], True)
    assert (rows[1].quality_score, rows[1].issues, rows[1].is_complete) == (0.0, ["Missing rubric"], None)
    assert rows[2].issues == ["Missing rubric"]
    assert rows[3].quality_score == pytest.approx(0.7)
    assert rows[3].issues == ["Missing maximum points criterion", "Missing zero points criterion"]
    assert rows[4].quality_score == pytest.approx(0.3)
    assert rows[4].issues == ["Missing points_possible", "Empty scoring criteria"]
