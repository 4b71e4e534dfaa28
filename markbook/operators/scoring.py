"""Scoring of student responses and the roll-ups of scores.

Flow of a whole run: the question bank is prepared once per question (keys
normalised, concepts found), every expected question of every sitting is paired
with its response, each pair is scored on its own row, and the scores are summed
by student and test, by subject and by question type in one pass.

Scoring one row needs no other row, so there is no shuffle between pairing and
summing.  Responses of all types go through one projection: a measure that does
not concern a row's type gets null text and does no work.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.config import DEFAULT, Config
from markbook.functions import text as tx
from markbook.functions.common import choose, is_blank, message_if, share, strip, true_or
from markbook.functions.similarity import content_words, similarity
from markbook.functions.stemming import stem_words
from markbook.plans.joins import first_match, lookup_join

# Feedback texts.
EXACT = "Exact match with correct answer"
VARIATION = "Matches acceptable variation"
GOOD_ANSWER = "Response demonstrates good understanding"
PARTIAL_ANSWER = "Response shows partial understanding"
WRONG_ANSWER = "Response does not demonstrate understanding"
CORRECT_CHOICE = "Correct! Well done."
EXCELLENT = "Excellent response!"
GOOD = "Good response with clear ideas."
ADEQUATE = "Adequate response that shows understanding."
UNDERDEVELOPED = "Your response needs more development."
WRITE_MORE = "Try to write more to fully explain your ideas."
CHECK_SPELLING = "Check your spelling and punctuation."
OFF_TOPIC = "Make sure your answer relates to the question."

# Advice to the learner.
OVERALL_LOW = "Continue practicing reading and literacy skills."
OVERALL_MIDDLE = "Good progress! Focus on areas that need improvement."
OVERALL_HIGH = "Excellent work! Keep up the great effort."
SUBJECT_ADVICE = {
    "reading_comprehension": "Practice reading comprehension with short stories and passages.",
    "vocabulary": "Work on expanding vocabulary through reading and word games.",
    "writing": "Practice descriptive writing and organizing ideas in paragraphs.",
    "language_conventions": "Review grammar, punctuation, and sentence structure.",
}

KEY = ["test_id", "question_id"]
BREAK = "\u0001"


def is_choice(question_type: Column) -> Column:
    return true_or(question_type == "multiple_choice")


def is_extended(question_type: Column) -> Column:
    return true_or(question_type == "extended_response")


def is_short(question_type: Column) -> Column:
    """Short answers; cloze, matching and unknown types follow the same rule."""
    return ~is_choice(question_type) & ~is_extended(question_type)


# --- multiple choice -------------------------------------------------------


def chosen_letter(response: Column) -> Column:
    """The letter picked: first A-D anywhere in longer text, else the first character."""
    given = F.upper(strip(F.coalesce(response, F.lit(""))))
    letter = F.regexp_extract(given, "[A-D]", 0)
    return F.when(F.length(given) <= 1, given).otherwise(
        F.when(letter != "", letter).otherwise(F.substring(given, 1, 1))
    )


def key_letter(answer: Column) -> Column:
    return F.upper(strip(answer))


def choice_feedback(is_correct: Column, answer: Column, explanation: Column) -> Column:
    correction = F.concat(F.lit("The correct answer is "), answer, F.lit("."))
    more = F.when(~is_blank(explanation), explanation)
    return F.when(is_correct, CORRECT_CHOICE).otherwise(F.concat_ws(" ", correction, more))


# --- short answers ---------------------------------------------------------


def short_answer_tier(matches: Column, varies: Column, alike: Column, cfg: Config) -> Column:
    """exact, variation, good, partial or wrong."""
    return (
        F.when(matches, "exact")
        .when(varies, "variation")
        .when(alike >= cfg.similarity_threshold, "good")
        .when(alike >= cfg.partial_threshold, "partial")
        .otherwise("wrong")
    )


def short_answer_points(tier: Column) -> Column:
    return F.when(tier == "wrong", 0).when(tier == "partial", 1).otherwise(2)


def short_answer_feedback(tier: Column) -> Column:
    return choose(
        tier,
        {"exact": EXACT, "variation": VARIATION, "good": GOOD_ANSWER, "partial": PARTIAL_ANSWER},
        WRONG_ANSWER,
    )


def short_answer_confidence(tier: Column, alike: Column) -> Column:
    return F.when(tier == "exact", 1.0).when(tier == "variation", 0.95).otherwise(alike)


# --- extended responses ----------------------------------------------------


def response_analysis(
    response: Column, lowered: Column, m: tx.Metrics, relevant: Column
) -> Column:
    """Struct of the measures of an extended response; zeros for blank text."""
    written = F.length(strip(F.coalesce(response, F.lit("")))) > 0
    on_topic = written & relevant
    pick = lambda value, blank: F.when(written, value).otherwise(F.lit(blank))
    return F.struct(
        pick(m.words, 0).alias("word_count"),
        pick(m.sentences, 0).alias("sentence_count"),
        on_topic.alias("has_content"),
        pick(tx.organization_score(lowered, m.sentences), 0.0).alias("organization_score"),
        pick(F.when(relevant, 0.8).otherwise(0.2), 0.0).alias("content_score"),
        pick(tx.language_quality(response, m), 0.0).alias("language_quality"),
    )


def extended_overall(analysis: Column, cfg: Config = DEFAULT) -> Column:
    """Weighted sum of content, language and length (30 words are complete)."""
    completeness = F.least(F.lit(1.0), analysis["word_count"] / F.lit(30))
    return (
        analysis["content_score"] * cfg.content_weight
        + analysis["language_quality"] * cfg.language_weight
        + completeness * cfg.completeness_weight
    )


def extended_points(has_content: Column, overall: Column, top: Column) -> Column:
    """Points by band; ``top`` is the highest of the rubric, null without criteria."""
    return (
        F.when(~has_content, 0)
        .when(overall >= 0.85, top)
        .when(overall >= 0.70, top - 1)
        .when(overall >= 0.50, top - 2)
        .when(overall >= 0.30, 1)
        .otherwise(0)
    )


def extended_feedback(analysis: Column, points: Column, possible: Column) -> Column:
    opening = (
        F.when(points == possible, EXCELLENT)
        .when(points >= possible * F.lit(0.75), GOOD)
        .when(points >= possible * F.lit(0.5), ADEQUATE)
        .otherwise(UNDERDEVELOPED)
    )
    return F.concat_ws(
        " ",
        opening,
        message_if(analysis["word_count"] < 20, WRITE_MORE),
        message_if(analysis["language_quality"] < 0.6, CHECK_SPELLING),
        message_if(~analysis["has_content"], OFF_TOPIC),
    )


# --- the bank and the items ------------------------------------------------


def prepare_bank(questions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """What scoring needs of each question, worked out once per question.

    Keeps the first question where an id occurs twice in a test.
    """
    kind = F.col("question_type")
    wordings = F.concat(
        F.array(F.coalesce("correct_answer.answer", F.lit(""))),
        F.coalesce("correct_answer.acceptable_variations", F.array().cast("array<string>")),
    )
    joined = F.array_join(
        F.transform(wordings, lambda w: content_words(w, cfg)), f" {BREAK} "
    )
    bank = first_match(questions, KEY, "question_no").select(
        *KEY,
        "question_no",
        kind,
        "subject_area",
        "question_text",
        F.col("correct_answer.answer").alias("answer"),
        F.col("correct_answer.explanation").alias("explanation"),
        F.col("scoring_rubric.points_possible").alias("points_possible"),
        F.array_max(
            F.transform("scoring_rubric.scoring_criteria", lambda c: c["points"])
        ).alias("top_points"),
        F.when(
            is_extended(kind), tx.question_concepts(F.col("question_text"), cfg.stop_words)
        ).alias("concepts"),
        stem_words(F.when(is_short(kind), joined)).alias("__stems"),
    )
    forms = F.transform(F.split("__stems", BREAK), lambda s: F.trim(s))
    return bank.withColumn("forms", forms).drop("__stems")


def score_items(items: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Score rows that hold a prepared question and a ``response``; adds the item score."""
    kind = F.col("question_type")
    response = F.coalesce("response", F.lit(""))
    short = F.when(is_short(kind), response)
    extended = F.when(is_extended(kind), response)

    df = items.withColumns(
        {
            "response": response,
            "__letter": F.when(is_choice(kind), chosen_letter(response)),
            "__key": F.when(is_choice(kind), key_letter(F.col("answer"))),
            "__lower": F.lower(extended),
        }
    )
    df = tx.with_metrics(df, extended, "r")
    df = df.withColumn("__form", stem_words(F.when(short.isNotNull(), content_words(short, cfg))))
    df = df.withColumns(
        {
            "__exact": true_or(F.col("__form") == F.get("forms", F.lit(0))),
            "__varies": true_or(F.array_contains("forms", F.col("__form"))),
            "__relevant": tx.is_relevant(F.col("concepts"), F.col("__lower")),
        }
    )
    # Only answers that match no wording are compared in full.
    open_answer = F.when(~F.col("__exact") & ~F.col("__varies"), short)
    df = df.withColumn("__alike", similarity(open_answer, F.col("answer"), cfg))
    df = df.withColumns(
        {
            "__tier": short_answer_tier(F.col("__exact"), F.col("__varies"), F.col("__alike"), cfg),
            "analysis": F.when(
                is_extended(kind),
                response_analysis(response, F.col("__lower"), tx.metrics_of("r"), F.col("__relevant")),
            ),
        }
    )
    df = df.withColumn("__overall", extended_overall(F.col("analysis"), cfg))
    possible, tier, analysis = F.col("points_possible"), F.col("__tier"), F.col("analysis")
    right_choice = F.col("__letter") == F.col("__key")
    short_points = short_answer_points(tier)
    if cfg.cap_to_possible:
        short_points = F.least(short_points, possible)
    df = df.withColumn(
        "points_earned",
        F.when(is_choice(kind), F.when(right_choice, possible).otherwise(0))
        .when(
            is_extended(kind),
            extended_points(analysis["has_content"], F.col("__overall"), F.col("top_points")),
        )
        .otherwise(short_points),
    )
    earned = F.col("points_earned")
    return df.withColumns(
        {
            "is_correct": F.when(is_choice(kind), true_or(right_choice))
            .when(is_extended(kind), earned >= possible * F.lit(0.6))
            .otherwise(tier.isin("exact", "variation", "good")),
            "confidence": F.when(is_choice(kind), 1.0)
            .when(is_extended(kind), 0.8)
            .otherwise(short_answer_confidence(tier, F.col("__alike"))),
            "feedback": F.when(
                is_choice(kind),
                choice_feedback(true_or(right_choice), F.col("answer"), F.col("explanation")),
            )
            .when(is_extended(kind), extended_feedback(analysis, earned, possible))
            .otherwise(short_answer_feedback(tier)),
            "error": F.when(
                is_extended(kind) & earned.isNull(), "rubric without scoring criteria"
            ),
            "student_answer": F.col("__letter"),
            "correct_answer": F.col("__key"),
        }
    ).drop(
        "__letter", "__key", "__lower", "__form", "__exact", "__varies", "__relevant", "__alike",
        "__tier", "__overall", "r_words", "r_sentences", "r_syllables",
        "answer", "explanation", "top_points", "concepts", "forms",
    )


def score_responses(
    bank: DataFrame, responses: DataFrame, cfg: Config = DEFAULT
) -> DataFrame:
    """Score responses to known questions; responses to unknown ids are dropped."""
    return score_items(lookup_join(responses, bank, KEY), cfg)


def score_tests(
    questions: DataFrame,
    responses: DataFrame,
    cfg: Config = DEFAULT,
    sittings: DataFrame | None = None,
) -> DataFrame:
    """Item scores of all students, one row per student, test and question.

    Every question of every test a student sat is scored, with the response or an
    empty one.  ``sittings`` (student_id, test_id) names who sat what, for students
    who may have answered nothing; whoever has a response sat the test anyway.  Only
    ids and response text are shuffled; the wide question columns join afterwards.
    Of several responses to one question the greatest counts.
    """
    seat = ["student_id", "test_id"]
    given = responses.groupBy(*seat, "question_id").agg(F.max("response").alias("response"))
    seats = responses.select(*seat)
    if sittings is not None:
        seats = seats.unionByName(sittings.select(*seat))
    ids = questions.select(*KEY).distinct()
    asked = lookup_join(seats.distinct(), ids, ["test_id"])
    expected = asked.join(given, [*seat, "question_id"], "left")
    return score_responses(prepare_bank(questions, cfg), expected, cfg)


# --- roll-ups --------------------------------------------------------------


def letter_grade(percentage: Column) -> Column:
    return (
        F.when(percentage >= 90, "A")
        .when(percentage >= 80, "B")
        .when(percentage >= 70, "C")
        .when(percentage >= 60, "D")
        .otherwise("F")
    )


def roll_up(items: DataFrame, keys: tuple = ("student_id", "test_id")) -> DataFrame:
    """Sums per student and test, per subject and per question type, in one pass.

    ``level`` tells the three kinds of rows apart, ``category`` names the subject
    or type; ``first_no`` is the place where it first occurs in the test.  Rows
    are summed to (subject, type) first, so that only small sums are repeated for
    the three levels.
    """
    names = list(keys)
    fine = items.groupBy(*names, "subject_area", "question_type").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_correct")).alias("correct"),
        F.sum("points_earned").alias("points_earned"),
        F.sum("points_possible").alias("points_possible"),
        F.min("question_no").alias("first_no"),
    )
    levels = fine.groupingSets(
        [names, [*names, "subject_area"], [*names, "question_type"]],
        *names,
        "subject_area",
        "question_type",
    ).agg(
        F.grouping_id().alias("__level"),
        F.sum("total").alias("total"),
        F.sum("correct").alias("correct"),
        F.sum("points_earned").alias("points_earned"),
        F.sum("points_possible").alias("points_possible"),
        F.min("first_no").alias("first_no"),
    )
    by_subject, by_type = F.col("__level") == 1, F.col("__level") == 2
    return levels.select(
        *names,
        F.when(by_subject, "subject").when(by_type, "question_type").otherwise("test").alias("level"),
        F.when(by_subject, F.col("subject_area"))
        .when(by_type, F.col("question_type"))
        .alias("category"),
        "total",
        "correct",
        "points_earned",
        "points_possible",
        (share(F.col("points_earned"), F.col("points_possible")) * 100).alias("percentage"),
        "first_no",
    )


def test_scores(rolled: DataFrame, keys: tuple = ("student_id", "test_id")) -> DataFrame:
    """One row per student and test with percentage and grade."""
    return rolled.filter(F.col("level") == "test").select(
        *keys,
        F.col("total").alias("total_questions"),
        "correct",
        F.col("points_earned").alias("total_points_earned"),
        F.col("points_possible").alias("total_points_possible"),
        F.col("percentage").alias("percentage_score"),
        letter_grade(F.col("percentage")).alias("overall_grade"),
    )


def overall_advice(percentage: Column) -> Column:
    return (
        F.when(percentage < 60, OVERALL_LOW)
        .when(percentage < 80, OVERALL_MIDDLE)
        .otherwise(OVERALL_HIGH)
    )


def recommendations(rolled: DataFrame, keys: tuple = ("student_id", "test_id")) -> DataFrame:
    """Advice per student and test: overall first, then weak known subjects in test order.

    At most one entry per known subject is gathered, so groups stay tiny.
    """
    advice = choose(F.col("category"), SUBJECT_ADVICE, None)
    weak = (F.col("level") == "subject") & (F.col("percentage") < 60) & advice.isNotNull()
    gathered = (
        rolled.filter((F.col("level") == "test") | weak)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("level") == "test", F.col("percentage"))).alias("__percentage"),
            F.array_sort(
                F.collect_list(F.when(weak, F.struct(F.col("first_no"), advice.alias("text"))))
            ).alias("__weak"),
        )
    )
    return gathered.select(
        *keys,
        F.concat(
            F.array(overall_advice(F.col("__percentage"))),
            F.transform("__weak", lambda w: w["text"]),
        ).alias("recommendations"),
    )
