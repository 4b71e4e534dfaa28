"""Question validation and quality.

Input: one row per question (``sources.documents.QUESTION_FIELDS``).  All
measures are Column expressions over one reading of the question text; the
frame functions add columns and never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions import text as tx
from markbook.functions.common import (
    choose,
    clamp,
    has_items,
    is_blank,
    message_if,
    messages,
    strip,
    true_or,
)

# How much each question type adds to the difficulty estimate.
TYPE_DIFFICULTY = {
    "multiple_choice": 0.0,
    "short_answer": 0.5,
    "extended_response": 1.0,
    "cloze": 0.3,
}
OTHER_TYPE_DIFFICULTY = 0.5

# Weights of the overall quality score.
QUALITY_WEIGHTS = {
    "validation": 0.3,
    "readability": 0.2,
    "appropriateness": 0.2,
    "difficulty_alignment": 0.15,
    "rubric_quality": 0.15,
}
HIGH_QUALITY, LOW_QUALITY = 0.8, 0.6

FEW_OPTIONS = "Multiple choice questions must have at least 2 options"


def _absent(struct: Column, *fields: str) -> Column:
    """The struct is null or, like an empty JSON object, has no field set."""
    empty = F.lit(True)
    for f in fields:
        empty = empty & struct[f].isNull()
    return struct.isNull() | empty


def no_answer(answer: Column) -> Column:
    return _absent(answer, "answer", "explanation", "acceptable_variations")


def no_rubric(rubric: Column) -> Column:
    return _absent(rubric, "points_possible", "scoring_criteria")


def stimulus_text(stimulus: Column) -> Column:
    """Content of the stimulus, null where there is none."""
    return F.when(~is_blank(stimulus["content"]), stimulus["content"])


def missing_fields(question_text: Column, answer: Column, rubric: Column) -> Column:
    """One error per required field without a value."""
    return messages(
        message_if(is_blank(question_text), "Missing required field: question_text"),
        message_if(no_answer(answer), "Missing required field: correct_answer"),
        message_if(no_rubric(rubric), "Missing required field: scoring_rubric"),
    )


def validation_score(
    appropriate: Column, objective: Column, tags: Column, explanation: Column
) -> Column:
    """1, -.3 hard to read, +.1 objective, +.1 tags, -.2 without explanation, in 0..1."""
    score = F.lit(1.0) - F.when(appropriate, 0.0).otherwise(0.3)
    score = score + F.when(is_blank(objective), 0.0).otherwise(0.1)
    score = score + F.when(has_items(tags), 0.1).otherwise(0.0)
    score = score - F.when(is_blank(explanation), 0.2).otherwise(0.0)
    return clamp(score, 0.0, 1.0)


def estimate_difficulty(grade: Column, indicators: list[Column], question_type: Column) -> Column:
    """1..5 from the reading level, wording flags and question type."""
    base = F.when(grade <= 2, 1).when(grade <= 3, 2).when(grade <= 4, 3).when(grade <= 5, 4)
    flags = sum((f.cast("int") for f in indicators), F.lit(0))
    added = choose(question_type, TYPE_DIFFICULTY, OTHER_TYPE_DIFFICULTY)
    return clamp(base.otherwise(5) + flags * F.lit(0.5) + added, 1.0, 5.0)


def alignment_score(stated: Column, estimated: Column) -> Column:
    """1 - |stated - estimated| / 5; an unstated difficulty counts as 3."""
    return F.lit(1.0) - F.abs(F.coalesce(stated, F.lit(3)) - estimated) / F.lit(5.0)


def rubric_quality(rubric: Column) -> Column:
    """Struct of score, issues and completeness of a scoring rubric."""
    criteria, points = rubric["scoring_criteria"], rubric["points_possible"]
    listed = has_items(criteria)
    nothing_written = lambda c: is_blank(strip(F.coalesce(c["criteria"], F.lit(""))))
    covered = lambda p: true_or(F.exists(criteria, lambda c: c["points"] == p))
    no_max = listed & ~covered(F.coalesce(points, F.lit(0)))
    no_zero = listed & ~covered(F.lit(0))

    score = F.lit(1.0) - F.when(points.isNull(), 0.3).otherwise(0.0)
    score = score - F.when(criteria.isNull(), 0.5).when(F.size(criteria) == 0, 0.4).otherwise(0.0)
    score = F.aggregate(
        F.coalesce(criteria, F.array().cast("array<struct<points:int,criteria:string>>")),
        score,
        lambda acc, c: acc - F.when(nothing_written(c), 0.1).otherwise(0.0),
    )
    score = score - F.when(no_max, 0.2).otherwise(0.0) - F.when(no_zero, 0.1).otherwise(0.0)

    issues = F.concat(
        messages(
            message_if(points.isNull(), "Missing points_possible"),
            F.when(criteria.isNull(), "Missing scoring_criteria").when(
                F.size(criteria) == 0, "Empty scoring criteria"
            ),
        ),
        F.when(
            listed,
            F.transform(
                F.filter(criteria, nothing_written),
                lambda c: F.lit("Incomplete criterion description"),
            ),
        ).otherwise(F.array().cast("array<string>")),
        messages(
            message_if(no_max, "Missing maximum points criterion"),
            message_if(no_zero, "Missing zero points criterion"),
        ),
    )
    empty = no_rubric(rubric)
    return F.struct(
        F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), score)).alias("quality_score"),
        F.when(empty, F.array(F.lit("Missing rubric"))).otherwise(issues).alias("issues"),
        F.when(~empty, F.size(issues) == 0).alias("is_complete"),
    )


def overall_quality(
    validation: Column,
    appropriate: Column,
    topic: Column,
    alignment: Column,
    rubric: Column,
) -> Column:
    """Weighted sum of the five part scores."""
    w = QUALITY_WEIGHTS
    readable = F.when(appropriate, 1.0).otherwise(0.5)
    return (
        validation * w["validation"]
        + readable * w["readability"]
        + topic * w["appropriateness"]
        + alignment * w["difficulty_alignment"]
        + rubric * w["rubric_quality"]
    )


def is_high_quality(score: Column) -> Column:
    return score >= HIGH_QUALITY


def is_low_quality(score: Column) -> Column:
    return score < LOW_QUALITY


def with_reading(df: DataFrame) -> DataFrame:
    """Add counts, grade and verdict of question text (q_) and stimulus (s_)."""
    df = tx.with_metrics(df, F.col("question_text"), "q")
    df = tx.with_metrics(df, stimulus_text(F.col("stimulus")), "s")
    for p in ("q", "s"):
        m = tx.metrics_of(p)
        df = df.withColumns(
            {
                f"{p}_grade": tx.readability(m),
                f"{p}_average": tx.average_sentence_length(m),
            }
        ).withColumn(
            f"{p}_ok",
            tx.is_age_appropriate(F.col(f"{p}_grade"), F.col(f"{p}_average"), m.words),
        )
    return df


READING_COLUMNS = tuple(
    f"{p}_{c}"
    for p in ("q", "s")
    for c in ("words", "sentences", "syllables", "grade", "average", "ok")
)


def _check(prefix: str) -> Column:
    return tx.age_check(F.col(f"{prefix}_grade"), tx.metrics_of(prefix))


def _advice(prefix: str) -> Column:
    words = F.col(f"{prefix}_words")
    given = tx.reading_advice(F.col(f"{prefix}_grade"), F.col(f"{prefix}_average"), words)
    return F.when(F.col(f"{prefix}_ok"), F.array().cast("array<string>")).otherwise(given)


def with_validation(df: DataFrame) -> DataFrame:
    """Add ``is_valid``, ``errors``, ``warnings``, ``validation_score`` (needs ``with_reading``)."""
    has_stimulus = stimulus_text(F.col("stimulus")).isNotNull()
    none = F.array().cast("array<string>")
    stimulus_advice = F.when(
        has_stimulus, F.transform(_advice("s"), lambda w: F.concat(F.lit("Stimulus: "), w))
    ).otherwise(none)
    complete = F.size("missing") == 0
    few = (F.col("question_type") == "multiple_choice") & (
        F.coalesce(F.size("options"), F.lit(0)) < 2
    )
    score = validation_score(
        F.col("q_ok"), F.col("learning_objective"), F.col("tags"), F.col("correct_answer.explanation")
    )
    return (
        df.withColumn(
            "missing",
            missing_fields(F.col("question_text"), F.col("correct_answer"), F.col("scoring_rubric")),
        )
        .withColumns(
            {
                "errors": F.when(
                    complete, messages(message_if(true_or(few), FEW_OPTIONS))
                ).otherwise(F.col("missing")),
                "warnings": F.when(complete, F.concat(_advice("q"), stimulus_advice)).otherwise(none),
                "validation_score": F.when(complete, score).otherwise(0.0),
            }
        )
        .withColumn("is_valid", F.size("errors") == 0)
        .drop("missing")
    )


def validate_questions(questions: DataFrame) -> DataFrame:
    """Validity, errors, warnings and score of every question."""
    return with_validation(with_reading(questions)).drop(*READING_COLUMNS)


def with_difficulty(df: DataFrame) -> DataFrame:
    """Add wording flags, estimated difficulty and alignment (needs ``with_reading``)."""
    flags = list(tx.INDICATORS)
    return (
        df.withColumn("q_lower", F.lower(F.coalesce("question_text", F.lit(""))))
        .withColumns(tx.complexity_indicators(F.col("q_lower")))
        .withColumn(
            "estimated_difficulty",
            estimate_difficulty(
                F.col("q_grade"), [F.col(f) for f in flags], F.col("question_type")
            ),
        )
        .withColumn(
            "alignment_score",
            alignment_score(F.col("difficulty_level"), F.col("estimated_difficulty")),
        )
        .withColumn("is_well_aligned", F.col("alignment_score") >= 0.7)
    )


def evaluate_questions(questions: DataFrame, keep: tuple = ()) -> DataFrame:
    """The full evaluation row of every question; ``keep`` names key columns to carry."""
    df = with_difficulty(with_validation(with_reading(questions)))
    df = df.withColumns(
        {
            "appropriateness_score": tx.topic_score(
                F.col("q_lower"),
                tx.appropriate_when_lowered(
                    F.coalesce("question_text", F.lit("")), F.col("q_ok")
                ),
            ),
            "rubric_quality": rubric_quality(F.col("scoring_rubric")),
        }
    ).withColumn("rubric_score", F.col("rubric_quality.quality_score"))
    has_stimulus = stimulus_text(F.col("stimulus")).isNotNull()
    return df.select(
        *keep,
        F.coalesce("question_id", F.lit("unknown")).alias("question_id"),
        "question_type",
        "subject_area",
        F.col("difficulty_level").alias("stated_difficulty"),
        F.struct("is_valid", "errors", "warnings", F.col("validation_score").alias("quality_score"))
        .alias("validation_result"),
        _check("q").alias("readability_metrics"),
        F.when(has_stimulus, _check("s")).alias("stimulus_metrics"),
        "appropriateness_score",
        F.struct(
            F.coalesce("difficulty_level", F.lit(3)).alias("stated_difficulty"),
            "estimated_difficulty",
            F.col("q_grade").alias("readability_level"),
            F.struct(*tx.INDICATORS).alias("complexity_indicators"),
            "alignment_score",
            "is_well_aligned",
        ).alias("difficulty_assessment"),
        "rubric_quality",
        overall_quality(
            F.col("validation_score"),
            F.col("q_ok"),
            F.col("appropriateness_score"),
            F.col("alignment_score"),
            F.col("rubric_score"),
        ).alias("quality_score"),
    )
