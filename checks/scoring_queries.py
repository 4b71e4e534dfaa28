"""Scoring of responses and roll-ups of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as b
from checks import sql as s
from checks.registry import big, joined, query, r6
from checks.text_queries import ANALYSIS
from markbook.config import DEFAULT
from markbook.operators import scoring as sc

POINTS = "case when chosen = key_letter then points_possible else 0 end"
CHOICE_FEEDBACK = f"""case when chosen = key_letter then '{sc.CORRECT_CHOICE}'
  else 'The correct answer is ' || key_letter || '.' || case when coalesce(explanation, '') <> '' then ' ' || explanation else '' end end"""


@query(
    "choice_scores",
    f"""with {b.DIALOGUE_SQL},
    c as (select conv_id, turn, chr((65 + conv_id % 4)::int) as key_letter, case when turn % 4 = 0 then 'Read again.' end as explanation,
      {s.letter("coalesce(response, '')")} as chosen, 1 as points_possible from dialogue)
    select conv_id, turn, chosen, chosen = key_letter as is_correct, ({POINTS})::bigint as points, {CHOICE_FEEDBACK} as feedback from c""",
)
def choice_scores(spark, sf):
    key = F.char(65 + F.col("conv_id") % 4)
    d = b.dialogue(spark, sf).select(
        "conv_id",
        "turn",
        key.alias("key"),
        F.when(F.col("turn") % 4 == 0, "Read again.").alias("explanation"),
        sc.chosen_letter(F.col("response")).alias("chosen"),
    )
    right = F.col("chosen") == sc.key_letter(F.col("key"))
    return d.select(
        "conv_id",
        "turn",
        "chosen",
        right.alias("is_correct"),
        big(F.when(right, 1).otherwise(0), "points"),
        sc.choice_feedback(right, F.col("key"), F.col("explanation")).alias("feedback"),
    )


def _short_bank(spark, sf):
    """A short-answer question per document: the source, or its language, is right."""
    d = b.table(spark, sf, "documents")
    return d.select(
        F.col("lang").alias("test_id"),
        F.col("doc_id").alias("question_no"),
        F.col("doc_id").cast("string").alias("question_id"),
        F.when(F.col("doc_id") % 2 == 0, "short_answer").otherwise("cloze").alias("question_type"),
        F.lit("vocabulary").alias("subject_area"),
        F.col("text").alias("question_text"),
        F.struct(
            F.concat(F.lit("The source: "), "source").alias("answer"),
            F.lit(None).cast("string").alias("explanation"),
            F.array(F.concat("lang", F.lit(" text"))).alias("acceptable_variations"),
        ).alias("correct_answer"),
        F.struct(
            F.lit(2).alias("points_possible"),
            F.array(F.struct(F.lit(2).alias("points"), F.lit("c").alias("criteria"))).alias("scoring_criteria"),
        ).alias("scoring_rubric"),
    )


# The five ways a document answers, by its id.  The last three are judged by likeness: what
# begins like the key has twice its own length in common with it, out of both lengths; the
# key's words are cut, so no word vector is closer.
SHORT_ANSWERS_SQL = f"""answered as (
  select *, 'The source: ' || source as key, case doc_id % 5
      when 0 then 'Sources ... THE ' || upper(source) when 1 then 'an ' || lang || '  Texts.'
      when 2 then left('The source: ' || source, length('The source: ' || source) - 1)
      when 3 then left('THE SOURCE: ' || source, 8) else repeat('z', (1 + doc_id % 7)::int) end as response
  from documents),
alike as (
  select *, case when starts_with(lower(key), lower(response))
      then 2 * length(response)::double / (length(response) + length(key)) else 0::double end as ratio
  from answered),
judged as (
  select doc_id, case doc_id % 5 when 0 then 'exact' when 1 then 'variation'
      else case when ratio >= 0.8 then 'good' when ratio >= 0.6 then 'partial' else 'wrong' end end as tier, ratio
  from alike)"""


@query(
    "short_answer_scores",
    f"""with {SHORT_ANSWERS_SQL} select doc_id::varchar as question_id,
      case tier when 'wrong' then 0::bigint when 'partial' then 1::bigint else 2::bigint end as points,
      tier in ('exact', 'variation', 'good') as is_correct,
      round(case tier when 'exact' then 1::double when 'variation' then 0.95::double else ratio end, 6) as confidence,
      case tier when 'exact' then '{sc.EXACT}' when 'variation' then '{sc.VARIATION}' when 'good' then '{sc.GOOD_ANSWER}'
        when 'partial' then '{sc.PARTIAL_ANSWER}' else '{sc.WRONG_ANSWER}' end as feedback from judged""",
)
def short_answer_scores(spark, sf):
    """Every document answered: exactly, by a variation, nearly, in part, or wrongly."""
    d = b.table(spark, sf, "documents")
    i, key = F.col("doc_id"), F.concat(F.lit("The source: "), "source")
    response = (
        F.when(i % 5 == 0, F.concat(F.lit("Sources ... THE "), F.upper("source")))
        .when(i % 5 == 1, F.concat(F.lit("an "), "lang", F.lit("  Texts.")))
        .when(i % 5 == 2, F.left(key, F.length(key) - 1))
        .when(i % 5 == 3, F.left(F.concat(F.lit("THE SOURCE: "), "source"), F.lit(8)))
        .otherwise(F.repeat(F.lit("z"), (1 + i % 7).cast("int")))
    )
    responses = d.select(
        F.lit("s").alias("student_id"),
        F.col("lang").alias("test_id"),
        i.cast("string").alias("question_id"),
        response.alias("response"),
    )
    scored = sc.score_responses(sc.prepare_bank(_short_bank(spark, sf)), responses)
    return scored.select("question_id", big("points_earned", "points"), "is_correct", r6("confidence"), "feedback")


@query("short_answer_similarity_scores")
def short_answer_similarity_scores(spark, sf):
    """Dialogue as short answers: the question text itself is the key."""
    bank = sc.prepare_bank(b.dialogue_bank(spark, sf, ("short_answer", "cloze")))
    scored = sc.score_responses(bank, b.dialogue_responses(spark, sf))
    return scored.select(
        "student_id", "test_id", "question_id", big("points_earned"), "is_correct", r6("confidence"), "feedback"
    )


EXTENDED_FEEDBACK = f"""case when points = 4 then '{sc.EXCELLENT}' when points >= 3 then '{sc.GOOD}'
    when points >= 2 then '{sc.ADEQUATE}' else '{sc.UNDERDEVELOPED}' end
  || case when word_count < 20 then ' {sc.WRITE_MORE}' else '' end
  || case when language_quality < 0.6 then ' {sc.CHECK_SPELLING}' else '' end
  || case when not has_content then ' {sc.OFF_TOPIC}' else '' end"""


@query(
    "extended_scores",
    f"""with {ANALYSIS}, p as (select *, {s.extended_points('4')} as points from a)
    select conv_id::varchar as test_id, turn::varchar as question_id, points::bigint as points,
      points >= 4 * 0.6::double as is_correct, 0.8::double as confidence, round({s.overall()}, 6) as overall,
      {EXTENDED_FEEDBACK} as feedback from p""",
)
def extended_scores(spark, sf):
    bank = sc.prepare_bank(b.dialogue_bank(spark, sf, ("extended_response",)))
    rows = b.dialogue(spark, sf).select(
        F.col("conv_id").cast("string").alias("test_id"),
        F.col("turn").cast("string").alias("question_id"),
        "response",
    )
    scored = sc.score_responses(bank, rows)
    return scored.select(
        "test_id",
        "question_id",
        big("points_earned", "points"),
        "is_correct",
        "confidence",
        r6(sc.extended_overall(F.col("analysis")), "overall"),
        "feedback",
    )


# Multiple-choice and extended questions of every conversation, scored as tests.
TEST_ITEMS_SQL = f"""{b.DIALOGUE_BANK_SQL},
sat as (select distinct student_id, test_id from responses),
asked as (select student_id, bank.*, coalesce(r.response, '') as response
  from sat join bank using (test_id) left join responses r using (student_id, test_id, question_id)),
x as ({s.analysis('asked', 'student_id, test_id, question_no, question_id, question_type, subject_area, key_letter, explanation, points_possible')}),
items as (select *, case when question_type = 'multiple_choice' then {POINTS} else {s.extended_points('4')} end as points_earned
  from (select *, {s.letter('response')} as chosen from x)),
judged as (select *, case when question_type = 'multiple_choice' then chosen = key_letter
   else points_earned >= points_possible * 0.6::double end as is_correct from items)"""


def _test_items(spark, sf):
    return sc.score_tests(b.dialogue_bank(spark, sf), b.dialogue_responses(spark, sf))


@query(
    "test_item_scores",
    f"""with {TEST_ITEMS_SQL} select student_id, test_id, question_id, question_type, subject_area,
    points_earned::bigint as points_earned, points_possible::bigint as points_possible, is_correct from judged""",
)
def test_item_scores(spark, sf):
    return _test_items(spark, sf).select(
        "student_id",
        "test_id",
        "question_id",
        "question_type",
        "subject_area",
        big("points_earned"),
        big("points_possible"),
        "is_correct",
    )


# Tests of all three kinds of questions: short answers are given exactly, by a variation, wrongly or not at all.
MIXED = ("multiple_choice", "short_answer", "extended_response")
_TURN_KIND = "(conv_id + turn // 2) % 2"
MIXED_BANK_SQL = (
    b.DIALOGUE_BANK_SQL.replace(f"['multiple_choice', 'extended_response'][{_TURN_KIND} + 1]", "['multiple_choice', 'short_answer', 'extended_response'][(conv_id + turn // 2) % 3 + 1]")
    .replace(f"case when {_TURN_KIND} = 0 then 1 else 4 end", "case when (conv_id + turn // 2) % 3 = 0 then 1 else 4 end")
    .replace("responses as (", "said as (")
)
MIXED_ITEMS_SQL = f"""{MIXED_BANK_SQL},
ways as (select *, (test_id::bigint + question_no // 2) // 3 % 4 as way from bank),
responses as (select said.* from said semi join bank on bank.test_id = said.test_id and bank.question_id = said.question_id and bank.question_type <> 'short_answer'
  union all select 's' || (test_id::bigint % 50), test_id, question_id,
    case way when 0 then '  reef... NUMBER ' || test_id || ' !' when 1 then 'The Coral, ' || test_id else '\u2603' end
  from ways where question_type = 'short_answer' and way < 3),
sat as (select distinct student_id, test_id from responses),
asked as (select student_id, w.*, coalesce(r.response, '') as response
  from sat join ways w using (test_id) left join responses r using (student_id, test_id, question_id)),
x as ({s.analysis('asked', 'student_id, test_id, question_no, question_id, question_type, subject_area, key_letter, explanation, points_possible, way')}),
items as (select *, case question_type when 'multiple_choice' then {POINTS} when 'short_answer' then case when way < 2 then 2 else 0 end
    else {s.extended_points('4')} end as points_earned
  from (select *, {s.letter('response')} as chosen from x)),
judged as (select *, case question_type when 'multiple_choice' then chosen = key_letter when 'short_answer' then way < 2
   else points_earned >= points_possible * 0.6::double end as is_correct from items)"""


def _mixed_items(spark, sf):
    bank, test = b.dialogue_bank(spark, sf, MIXED), F.col("test_id")
    short = F.col("question_type") == "short_answer"
    way = F.floor((test.cast("bigint") + F.floor(F.col("question_no") / 2)) / 3) % 4
    key = F.struct(
        F.concat(F.lit("Reef number "), test).alias("answer"),
        F.lit(None).cast("string").alias("explanation"),
        F.array(F.concat(F.lit("coral "), test)).alias("acceptable_variations"),
    )
    bank = bank.withColumn("correct_answer", F.when(short, key).otherwise(F.col("correct_answer")))
    said = b.dialogue_responses(spark, sf).join(bank.where(~short), ["test_id", "question_id"], "left_semi")
    response = (
        F.when(way == 0, F.concat(F.lit("  reef... NUMBER "), test, F.lit(" !")))
        .when(way == 1, F.concat(F.lit("The Coral, "), test))
        .otherwise("\u2603")
    )
    student = F.concat(F.lit("s"), (test.cast("bigint") % 50).cast("string"))
    given = bank.where(short & (way < 3)).select(student.alias("student_id"), "test_id", "question_id", response.alias("response"))
    return sc.score_tests(bank, said.unionByName(given))


@query(
    "mixed_item_scores",
    f"""with {MIXED_ITEMS_SQL} select student_id, test_id, question_id, question_type, points_earned::bigint as points_earned,
    points_possible::bigint as points_possible, is_correct from judged""",
)
def mixed_item_scores(spark, sf):
    """Whole tests of choices, short answers and essays, every question scored by its kind."""
    items = _mixed_items(spark, sf)
    return items.select(
        "student_id", "test_id", "question_id", "question_type", big("points_earned"), big("points_possible"), "is_correct"
    )


@query(
    "mixed_test_scores",
    f"""with {MIXED_ITEMS_SQL} select student_id, test_id, sum(points_earned)::bigint as earned, sum(points_possible)::bigint as possible,
      count(*) filter (is_correct) as correct, round(sum(points_earned)::double / sum(points_possible) * 100, 6) as percentage
    from judged group by student_id, test_id""",
)
def mixed_test_scores(spark, sf):
    """The same tests as totals."""
    told = sc.test_scores(sc.roll_up(_mixed_items(spark, sf)))
    return told.select(
        "student_id",
        "test_id",
        big("total_points_earned", "earned"),
        big("total_points_possible", "possible"),
        big("correct"),
        r6("percentage_score", "percentage"),
    )


# The same tests with one more student each, who answered nothing.
ABSENT_ITEMS_SQL = TEST_ITEMS_SQL.replace(
    "sat as (select distinct student_id, test_id from responses)",
    "sat as (select distinct student_id, test_id from responses union select 'absent', test_id from bank)",
)


@query(
    "sittings_without_answers",
    f"""with {ABSENT_ITEMS_SQL} select student_id, test_id, question_id, response, points_earned::bigint as points_earned,
    is_correct from judged""",
)
def sittings_without_answers(spark, sf):
    bank = b.dialogue_bank(spark, sf)
    absent = bank.select(F.lit("absent").alias("student_id"), "test_id").distinct()
    items = sc.score_tests(bank, b.dialogue_responses(spark, sf), sittings=absent)
    return items.select("student_id", "test_id", "question_id", "response", big("points_earned"), "is_correct")


def _rollup_sql(items: str) -> str:
    cell = "count(*) as total, count(*) filter (is_correct) as correct, sum(points_earned)::bigint as earned, sum(points_possible)::bigint as possible, min(question_no) as first_no"
    return f"""
rolled as (
  select student_id, test_id, 'test' as level, null as category, {cell} from {items} group by all
  union all select student_id, test_id, 'subject', subject_area, {cell} from {items} group by all
  union all select student_id, test_id, 'question_type', question_type, {cell} from {items} group by all),
scored as (select *, case when possible = 0 then 0::double else earned::double / possible * 100 end as percentage from rolled),
graded as (select *, {s.grade('percentage')} as grade from scored where level = 'test'),
weak as (select student_id, test_id, list(line order by first_no, line) as lines from (
  select *, case category {' '.join(f"when '{k}' then '{v}'" for k, v in sc.SUBJECT_ADVICE.items())} end as line
  from scored where level = 'subject' and percentage < 60 and category in ({s.quoted(sc.SUBJECT_ADVICE)})) group by all),
advised as (select g.student_id, g.test_id, array_to_string(list_concat([case when percentage < 60 then '{sc.OVERALL_LOW}'
    when percentage < 80 then '{sc.OVERALL_MIDDLE}' else '{sc.OVERALL_HIGH}' end], coalesce(lines, [])), ' | ') as recommendations
  from graded g left join weak using (student_id, test_id))"""


ROLLUP = """select student_id, test_id, level, category, total, correct, earned as points_earned,
  possible as points_possible, round(percentage, 6) as percentage from scored"""
GRADES = """select student_id, test_id, total as total_questions, correct, earned as total_points_earned,
  possible as total_points_possible, round(percentage, 6) as percentage_score, grade as overall_grade from graded"""


def _rollup_columns(rolled):
    return rolled.select(
        "student_id", "test_id", "level", "category", "total", "correct",
        "points_earned", "points_possible", r6("percentage"),
    )


@query("test_rollup", f"with {TEST_ITEMS_SQL}, {_rollup_sql('judged')} {ROLLUP}")
def test_rollup(spark, sf):
    return _rollup_columns(sc.roll_up(_test_items(spark, sf)))


@query("test_scores", f"with {TEST_ITEMS_SQL}, {_rollup_sql('judged')} {GRADES}")
def test_scores(spark, sf):
    t = sc.test_scores(sc.roll_up(_test_items(spark, sf)))
    return t.withColumn("percentage_score", F.round("percentage_score", 6))


@query(
    "test_recommendations",
    f"with {TEST_ITEMS_SQL}, {_rollup_sql('judged')} select * from advised",
)
def test_recommendations(spark, sf):
    r = sc.recommendations(sc.roll_up(_test_items(spark, sf)))
    return r.select("student_id", "test_id", joined("recommendations", "recommendations"))


@query("score_rollup", f"with {b.SCORED_ITEMS_SQL}, {_rollup_sql('items')} {ROLLUP}")
def score_rollup(spark, sf):
    return _rollup_columns(sc.roll_up(b.scored_items(spark, sf)))


@query("score_grades", f"with {b.SCORED_ITEMS_SQL}, {_rollup_sql('items')} {GRADES}")
def score_grades(spark, sf):
    t = sc.test_scores(sc.roll_up(b.scored_items(spark, sf)))
    return t.withColumn("percentage_score", F.round("percentage_score", 6))


@query(
    "learner_recommendations",
    f"with {b.SCORED_ITEMS_SQL}, {_rollup_sql('items')} select * from advised",
)
def learner_recommendations(spark, sf):
    r = sc.recommendations(sc.roll_up(b.scored_items(spark, sf)))
    return r.select("student_id", "test_id", joined("recommendations", "recommendations"))


# --- agreement of automatic with human scores ------------------------------

HUMAN_SQL = f"""{b.DIALOGUE_BANK_SQL},
human as (select test_id, question_id, response, (hash_no % 5)::int as points from (
   select *, (test_id::bigint * 7 + question_id::bigint * 3) as hash_no from responses)),
y as (select bank.*, human.response, human.points as human_score from human join bank using (test_id, question_id)),
z as ({s.analysis('y', 'test_id, question_no, question_id, question_type, key_letter, points_possible, human_score')}),
detail as (select *, case when question_type = 'multiple_choice' then {POINTS} else {s.extended_points('4')} end as automated_score
  from (select *, {s.letter('response')} as chosen from z))"""


@query(
    "agreement_detail",
    f"""with {HUMAN_SQL} select test_id, question_id, question_type, human_score::bigint as human_score,
    automated_score::bigint as automated_score, abs(human_score - automated_score)::bigint as difference,
    human_score = automated_score as agreement,
    case when question_type = 'multiple_choice' then 1::double else 0.8::double end as confidence from detail""",
)
def agreement_detail(spark, sf):
    from markbook.operators.evaluation import agreement_detail as detail

    number = F.col("test_id").cast("bigint") * 7 + F.col("question_id").cast("bigint") * 3
    human = b.dialogue_responses(spark, sf).select(
        "test_id",
        "question_id",
        F.col("response").alias("student_response"),
        (number % 5).cast("int").alias("points_earned"),
    )
    d = detail(sc.prepare_bank(b.dialogue_bank(spark, sf)), human, DEFAULT)
    return d.select(
        "test_id",
        "question_id",
        "question_type",
        big("human_score"),
        big("automated_score"),
        big("difference"),
        "agreement",
        "confidence",
    )
