"""Question validation, quality and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as b
from checks import sql as s
from checks.registry import big, joined, query, r6
from markbook.config import SUBJECTS
from markbook.operators import evaluation as ev
from markbook.operators import quality as q
from markbook.plans.joins import first_match
from markbook.sources import documents as docs

# Two readings (question text and stimulus), then validation, difficulty, rubric.
READ_SQL = f"""{b.QUESTIONS_SQL},
q1 as ({s.metrics('question_text', 'q', 'questions')}),
q2 as ({s.metrics("coalesce(stimulus_text, '')", 's', 'q1')})"""

MISSING = """list_filter([
  case when question_text is null or question_text = '' then 'Missing required field: question_text' end,
  case when not has_answer then 'Missing required field: correct_answer' end,
  case when not has_rubric then 'Missing required field: scoring_rubric' end], lambda m: m is not null)"""
VALIDATE_SQL = f"""{READ_SQL},
q3 as (select *, {MISSING} as missing from q2),
valid as (select *,
  case when len(missing) > 0 then missing
       when question_type = 'multiple_choice' and coalesce(len(options), 0) < 2 then ['{q.FEW_OPTIONS}'] else [] end as errors,
  case when len(missing) > 0 then [] else list_concat(
     case when q_ok then [] else {s.advice('q')} end,
     case when stimulus_text is null or s_ok then [] else [ 'Stimulus: ' || m for m in {s.advice('s')} ] end) end as warnings,
  case when len(missing) > 0 then 0::double else greatest(0::double, least(1::double, 1::double
     - (case when q_ok then 0::double else 0.3::double end)
     + (case when coalesce(learning_objective, '') <> '' then 0.1::double else 0::double end)
     + (case when len(tags) > 0 then 0.1::double else 0::double end)
     - (case when coalesce(explanation, '') = '' then 0.2::double else 0::double end))) end as validation_score
  from q3)"""

DIFFICULTY_SQL = f"""{VALIDATE_SQL},
d1 as (select *, {s.indicators('lower(question_text)')} from valid),
d2 as (select *, greatest(1::double, least(5::double,
    (case when q_grade <= 2 then 1 when q_grade <= 3 then 2 when q_grade <= 4 then 3 when q_grade <= 5 then 4 else 5 end)::double
    + (multi_step::int + inference_required::int + comparison_required::int + analysis_required::int) * 0.5::double
    + case question_type when 'multiple_choice' then 0::double when 'short_answer' then 0.5::double
        when 'extended_response' then 1::double when 'cloze' then 0.3::double else 0.5::double end)) as estimated from d1),
d3 as (select *, 1::double - abs(coalesce(difficulty_level, 3)::double - estimated) / 5::double as alignment from d2)"""

COVERED = "len([c for c in criteria if c.points = {p}]) > 0"
BLANKS = "len([c for c in criteria if trim(coalesce(c.criteria, ''), ' ' || chr(9) || chr(10) || chr(13)) = ''])"
RUBRIC_SQL = f"""
  select *,
    case when not has_rubric then 0::double else greatest(0::double, 1::double
      - (case when points_possible is null then 0.3::double else 0::double end)
      - (case when criteria is null then 0.5::double when len(criteria) = 0 then 0.4::double else 0::double end)
      - coalesce({BLANKS}, 0) * 0.1::double
      - (case when len(criteria) > 0 and not {COVERED.format(p='coalesce(points_possible, 0)')} then 0.2::double else 0::double end)
      - (case when len(criteria) > 0 and not {COVERED.format(p=0)} then 0.1::double else 0::double end)) end as rubric_score,
    case when not has_rubric then ['Missing rubric'] else list_concat(list_concat(list_filter([
        case when points_possible is null then 'Missing points_possible' end,
        case when criteria is null then 'Missing scoring_criteria' when len(criteria) = 0 then 'Empty scoring criteria' end], lambda m: m is not null),
      ['Incomplete criterion description' for i in range(0, coalesce({BLANKS}, 0))]), list_filter([
        case when len(criteria) > 0 and not {COVERED.format(p='coalesce(points_possible, 0)')} then 'Missing maximum points criterion' end,
        case when len(criteria) > 0 and not {COVERED.format(p=0)} then 'Missing zero points criterion' end], lambda m: m is not null)) end as issues"""

EVALUATE_SQL = f"""{DIFFICULTY_SQL},
e1 as ({RUBRIC_SQL}, {s.topic_score('lower(question_text)', 'q_ok')} as topic from d3),
evals as (select *, validation_score * 0.3::double + (case when q_ok then 1::double else 0.5::double end) * 0.2::double
   + topic * 0.2::double + alignment * 0.15::double + rubric_score * 0.15::double as quality_score from e1)"""


@query(
    "question_validation",
    f"""with {VALIDATE_SQL} select question_id, len(errors) = 0 as is_valid, array_to_string(errors, ' | ') as errors,
    array_to_string(warnings, ' | ') as warnings, round(validation_score, 6) as validation_score from valid""",
)
def question_validation(spark, sf):
    v = q.validate_questions(b.questions(spark, sf))
    return v.select(
        "question_id", "is_valid", joined("errors", "errors"), joined("warnings", "warnings"), r6("validation_score")
    )


@query(
    "difficulty_alignment",
    f"""with {DIFFICULTY_SQL} select question_id, round(estimated, 6) as estimated_difficulty,
    round(alignment, 6) as alignment_score, alignment >= 0.7 as is_well_aligned from d3""",
)
def difficulty_alignment(spark, sf):
    d = q.with_difficulty(q.with_reading(b.questions(spark, sf)))
    return d.select("question_id", r6("estimated_difficulty"), r6("alignment_score"), "is_well_aligned")


@query(
    "rubric_quality",
    f"""with {b.QUESTIONS_SQL}, r as ({RUBRIC_SQL} from questions)
    select question_id, round(rubric_score, 6) as rubric_score, array_to_string(issues, ' | ') as issues,
    case when has_rubric then len(issues) = 0 end as is_complete from r""",
)
def rubric_quality(spark, sf):
    r = b.questions(spark, sf).select("question_id", q.rubric_quality(F.col("scoring_rubric")).alias("r"))
    return r.select(
        "question_id", r6("r.quality_score", "rubric_score"), joined("r.issues", "issues"), "r.is_complete"
    )


@query(
    "question_evaluation",
    f"""with {EVALUATE_SQL} select question_id, question_type, subject_area, len(errors) = 0 as is_valid,
    round(q_grade, 6) as grade, case when stimulus_text is not null then round(s_grade, 6) end as stimulus_grade,
    round(topic, 6) as appropriateness, round(alignment, 6) as alignment, round(rubric_score, 6) as rubric_score,
    round(quality_score, 6) as quality_score from evals""",
)
def question_evaluation(spark, sf):
    e = q.evaluate_questions(b.questions(spark, sf))
    return e.select(
        "question_id",
        "question_type",
        "subject_area",
        "validation_result.is_valid",
        r6("readability_metrics.readability_level", "grade"),
        r6("stimulus_metrics.readability_level", "stimulus_grade"),
        r6("appropriateness_score", "appropriateness"),
        r6("difficulty_assessment.alignment_score", "alignment"),
        r6("rubric_quality.quality_score", "rubric_score"),
        r6("quality_score"),
    )


@query(
    "quality_bands",
    f"""with {EVALUATE_SQL} select subject_area, count(*) filter (round(quality_score, 9) >= 0.8) as high,
    count(*) filter (round(quality_score, 9) < 0.6) as low,
    count(*) filter (q_grade between 2 and 4) as readable from evals group by subject_area""",
)
def quality_bands(spark, sf):
    e = q.evaluate_questions(b.questions(spark, sf))
    return e.groupBy("subject_area").agg(
        F.count_if(q.is_high_quality(F.round("quality_score", 9))).alias("high"),
        F.count_if(q.is_low_quality(F.round("quality_score", 9))).alias("low"),
        F.count_if(F.col("readability_metrics.readability_level").between(2.0, 4.0)).alias("readable"),
    )


SUMMARY_SQL = f"""{EVALUATE_SQL},
summary as (select test_id, count(*) as total_questions, avg(quality_score) as average_quality_score,
   stddev_pop(quality_score) as quality_score_std, avg(q_grade) as average_readability,
   avg((q_grade between 2 and 4)::int::double) as readability_appropriateness_rate,
   avg(topic) as average_appropriateness, count(*) filter (quality_score >= 0.8) as high_quality_questions,
   count(*) filter (quality_score < 0.6) as low_quality_questions from evals group by test_id)"""


@query(
    "quality_summary",
    f"""with {SUMMARY_SQL} select test_id, total_questions, round(average_quality_score, 6) as average_quality_score,
    round(quality_score_std, 6) as quality_score_std, round(average_readability, 6) as average_readability,
    round(readability_appropriateness_rate, 6) as readability_appropriateness_rate,
    round(average_appropriateness, 6) as average_appropriateness from summary""",
)
def quality_summary(spark, sf):
    summary = ev.quality_summary(q.evaluate_questions(b.questions(spark, sf), ("test_id",)))
    return summary.select(
        "test_id",
        "total_questions",
        r6("average_quality_score"),
        r6("quality_score_std"),
        r6("average_readability"),
        r6("readability_appropriateness_rate"),
        r6("average_appropriateness"),
    )


SHARES_SQL = """
counted as (
  select test_id, 'subject' as dimension, coalesce(subject_area, 'unknown') as category, count(*) as n from questions group by all
  union all select test_id, 'difficulty', coalesce(difficulty_level, 0)::varchar, count(*) from questions group by all
  union all select test_id, 'question_type', coalesce(question_type, 'unknown'), count(*) from questions group by all),
shares as (select *, n::double / sum(n) over (partition by test_id, dimension) as share from counted),
balances as (
  select test_id, coalesce(-sum(share * log2(share)) filter (dimension = 'subject'), 0) + 0::double as subject_entropy,
    coalesce(-sum(share * log2(share)) filter (dimension = 'difficulty'), 0) + 0::double as difficulty_entropy,
    coalesce(-sum(share * log2(share)) filter (dimension = 'question_type'), 0) + 0::double as question_type_entropy
  from shares group by test_id),
balanced as (select *, (subject_entropy + difficulty_entropy + question_type_entropy) / log2(5) / 3 as balance_score from balances)"""


@query(
    "category_distribution",
    f"with {b.QUESTIONS_SQL}, {SHARES_SQL} select test_id, dimension, category, n, round(share, 6) as share from shares",
)
def category_distribution(spark, sf):
    d = ev.distribution(b.questions(spark, sf))
    return d.select("test_id", "dimension", "category", "n", r6("share"))


@query(
    "balance_score",
    f"""with {b.QUESTIONS_SQL}, {SHARES_SQL} select test_id, round(subject_entropy, 6) as subject_entropy,
    round(difficulty_entropy, 6) as difficulty_entropy, round(question_type_entropy, 6) as question_type_entropy,
    round(balance_score, 6) as balance_score from balanced""",
)
def balance_score(spark, sf):
    x = ev.balance(ev.distribution(b.questions(spark, sf)))
    return x.select(
        "test_id", r6("subject_entropy"), r6("difficulty_entropy"), r6("question_type_entropy"), r6("balance_score")
    )


ADVICE = f"""list_filter([
  case when average_quality_score < 0.7 then '{ev.LOW_OVERALL}' end,
  case when readability_appropriateness_rate < 0.8 then '{ev.BAD_READING}' end,
  case when balance_score < 0.6 then '{ev.UNBALANCED}' end,
  case when low_quality_questions > total_questions * 0.2::double then '{ev.MANY_LOW}' end], lambda m: m is not null)"""


def _advised(spark, sf):
    cells = ev.quality_cells(q.evaluate_questions(b.questions(spark, sf), ("test_id",)))
    shares = ev.distribution(cells, count=F.col("n"))
    return ev.quality_advice(ev.cell_summary(cells), ev.balance(shares))


@query(
    "quality_advice",
    f"""with {SUMMARY_SQL}, {SHARES_SQL} select test_id, array_to_string({ADVICE}, ' | ') as recommendations
    from summary join balanced using (test_id)""",
)
def quality_advice(spark, sf):
    return _advised(spark, sf).select("test_id", joined("recommendations", "recommendations"))


@query(
    "quality_report",
    f"""with {SUMMARY_SQL}, {SHARES_SQL},
    w as (select *, {ADVICE} as advice from summary join balanced using (test_id)),
    m as (
      select test_id, 1 as rank, 'total_questions' as metric, total_questions::double as value, null::varchar as text from w
      union all select test_id, 2, 'average_quality_score', average_quality_score, null from w
      union all select test_id, 3, 'high_quality_questions', high_quality_questions::double, null from w
      union all select test_id, 4, 'low_quality_questions', low_quality_questions::double, null from w
      union all select test_id, 5, 'readability_appropriateness_rate', readability_appropriateness_rate, null from w
      union all select test_id, 5 + unnest(range(1, len(advice) + 1)), 'recommendation', null, unnest(advice) from w)
    select test_id, 'quality' as section, rank::bigint as rank, metric, round(value, 6) as value, text from m""",
)
def quality_report(spark, sf):
    r = ev.report_rows(_advised(spark, sf), "quality", ev.QUALITY_REPORT, ("test_id",))
    return r.select("test_id", "section", big("rank"), "metric", r6("value"), "text")


# --- agreement -------------------------------------------------------------

PAIRS_SQL = f"""{EVALUATE_SQL},
pairs as (select e.test_id, e.question_no, e.question_type, l.quality::int as human_score,
    (round(quality_score, 9) >= 0.6)::int as automated_score
  from evals e join labels l using (doc_id))"""


def _label_pairs(spark, sf):
    """Human quality labels against the quality score at a threshold."""
    labels = b.table(spark, sf, "labels").select(
        F.col("doc_id").alias("question_no"), F.col("quality").cast("int").alias("human_score")
    )
    # Labels first: only questions that people have judged are evaluated.
    labelled = b.questions(spark, sf).join(labels, "question_no")
    e = q.evaluate_questions(labelled, ("test_id", "question_no", "human_score"))
    machine = (F.round("quality_score", 9) >= 0.6).cast("int")
    return ev.compare_scores(
        e.select("test_id", "question_no", "question_type", "human_score", machine.alias("automated_score"))
    )


def _metric_sql(group: str) -> str:
    keys = f"{group}, " if group else ""
    using = f"using ({group})" if group else "on true"
    by = f"group by {group}" if group else ""
    return f"""
base as (select {keys}count(*) as total_comparisons, avg((human_score = automated_score)::int::double) as exact,
    avg((abs(human_score - automated_score) <= 1)::int::double) as near, avg(abs(human_score - automated_score)::double) as mae,
    case when count(*) <= 1 then 0::double
      when var_pop(human_score) = 0 or var_pop(automated_score) = 0 then null
      else corr(human_score, automated_score) end as correlation from pairs {by}),
hm as (select {keys}human_score as label, count(*)::double as n from pairs group by all),
am as (select {keys}automated_score as label, count(*)::double as n from pairs group by all),
ch as (select {'hm.' + group + ' as ' + group + ', ' if group else ''}sum(hm.n * am.n) as chance from hm join am
   on hm.label = am.label {'and hm.' + group + ' = am.' + group if group else ''} {'group by hm.' + group if group else ''}),
metrics as (select base.*, (exact - coalesce(chance, 0) / (total_comparisons::double ** 2))
   / nullif(1 - coalesce(chance, 0) / (total_comparisons::double ** 2), 0) as kappa from base left join ch {using})"""


METRIC_COLUMNS = """total_comparisons, round(exact, 6) as exact_agreement_rate, round(correlation, 6) as correlation,
 round(mae, 6) as mean_absolute_error, round(kappa, 6) as cohens_kappa, round(near, 6) as within_one_point_agreement"""


def _metric_columns():
    return [
        "total_comparisons",
        r6("exact_agreement_rate"),
        r6("correlation"),
        r6("mean_absolute_error"),
        r6("cohens_kappa"),
        r6("within_one_point_agreement"),
    ]


@query("agreement_metrics", f"with {PAIRS_SQL}, {_metric_sql('')} select {METRIC_COLUMNS} from metrics")
def agreement_metrics(spark, sf):
    return ev.agreement_metrics(_label_pairs(spark, sf)).select(*_metric_columns())


@query(
    "agreement_metrics_by_test",
    f"with {PAIRS_SQL}, {_metric_sql('test_id')} select test_id, {METRIC_COLUMNS} from metrics",
)
def agreement_metrics_by_test(spark, sf):
    return ev.agreement_metrics(_label_pairs(spark, sf), ("test_id",)).select("test_id", *_metric_columns())


# Line items give a million-row agreement table with many score values.
ITEM_PAIRS_SQL = """
pairs as (select l_shipmode_like as test_id, h as human_score, a as automated_score from (
  select l_linestatus as l_shipmode_like, floor(l_quantity / 5)::int as h,
    floor(l_quantity * (1 - l_discount * 4) / 5)::int as a from lineitem))"""


@query(
    "agreement_at_volume",
    f"with {ITEM_PAIRS_SQL}, {_metric_sql('test_id')} select test_id, {METRIC_COLUMNS} from metrics",
)
def agreement_at_volume(spark, sf):
    li = b.table(spark, sf, "lineitem")
    pairs = li.select(
        F.col("l_linestatus").alias("test_id"),
        F.floor(F.col("l_quantity") / 5).cast("int").alias("human_score"),
        F.floor(F.col("l_quantity") * (1 - F.col("l_discount") * 4) / 5).cast("int").alias("automated_score"),
    )
    return ev.agreement_metrics(pairs, ("test_id",)).select("test_id", *_metric_columns())


BY_TYPE_SQL = """
by_type as (select question_type, avg((human_score = automated_score)::int::double) as rate, count(*) as n,
    min(question_no) as first_no from pairs group by question_type)"""


@query(
    "agreement_by_type",
    f"with {PAIRS_SQL}, {BY_TYPE_SQL} select question_type, round(rate, 6) as agreement_rate, n, first_no::bigint as first_no from by_type",
)
def agreement_by_type(spark, sf):
    t = ev.agreement_by_type(_label_pairs(spark, sf))
    return t.select("question_type", r6("agreement_rate"), "n", big("first_no"))


SCORING_ADVICE_SQL = f"""{PAIRS_SQL}, {BY_TYPE_SQL}, {_metric_sql('')},
weak as (select list('Scoring accuracy for ' || question_type || ' questions is low. Review specific scoring logic.' order by first_no)
   filter (rate < 0.7) as lines from by_type),
advised as (select metrics.*, list_concat(list_filter([
  case when exact < 0.8 then '{ev.LOW_EXACT}' end,
  case when correlation < 0.7 then '{ev.LOW_CORRELATION}' end,
  case when mae > 1.0 then '{ev.HIGH_ERROR}' end,
  case when kappa < 0.6 then '{ev.LOW_KAPPA}' end], lambda m: m is not null), coalesce(lines, [])) as advice
from metrics, weak)"""


@query(
    "scoring_advice",
    f"with {SCORING_ADVICE_SQL} select array_to_string(advice, ' | ') as recommendations from advised",
)
def scoring_advice(spark, sf):
    a = ev.scoring_advice(_label_pairs(spark, sf))
    return a.select(joined("recommendations", "recommendations"))


@query(
    "agreement_report",
    f"""with {SCORING_ADVICE_SQL}, m as (
      select 1 as rank, 'total_comparisons' as metric, total_comparisons::double as value, null::varchar as text from advised
      union all select 2, 'exact_agreement_rate', exact, null from advised
      union all select 3, 'correlation', correlation, null from advised
      union all select 4, 'mean_absolute_error', mae, null from advised
      union all select 5, 'cohens_kappa', kappa, null from advised
      union all select 5 + unnest(range(1, len(advice) + 1)), 'recommendation', null, unnest(advice) from advised)
    select 'scoring' as section, rank::bigint as rank, metric, round(value, 6) as value, text from m""",
)
def agreement_report(spark, sf):
    r = ev.report_rows(ev.scoring_advice(_label_pairs(spark, sf)), "scoring", ev.AGREEMENT_REPORT)
    return r.select("section", big("rank"), "metric", r6("value"), "text")


# --- documents -------------------------------------------------------------

DOCUMENT_RULES = f"""
d as (select *, doc_id % 13 = 0 as no_year, doc_id % 7 = 0 as bad_grade, doc_id % 9 = 0 as bad_area,
   doc_id % 8 as level, doc_id % 10 = 0 as bad_subject, doc_id % 11 = 10 as no_answer,
   doc_id % 6 = 0 as no_points, doc_id % 17 = 0 as not_json from documents),
v as (select doc_id, source, not_json, case when not_json then ['not JSON'] else list_filter([
    case when bad_grade then 'test_metadata.grade_level: not allowed' end,
    case when no_year then 'test_metadata.year: missing' end,
    case when bad_area then 'test_metadata.subject_areas[1]: not allowed' end,
    case when bad_subject then 'questions[0].subject_area: not allowed' end,
    case when level not between 1 and 5 then 'questions[0].difficulty_level: outside 1..5' end,
    case when no_answer then 'questions[0].correct_answer: missing' end,
    case when no_points then 'questions[0].scoring_rubric.points_possible: missing' end], lambda m: m is not null) end as violations from d)"""


def _documents(spark, sf):
    """Every document as a test of one question in JSON, some breaking a rule."""
    d = b.table(spark, sf, "documents")
    i = F.col("doc_id")
    meta = F.struct(
        F.col("source").alias("test_id"),
        F.when(i % 13 != 0, i % 30 + 2000).alias("year"),
        F.when(i % 7 == 0, "Year 4").otherwise("Year 3").alias("grade_level"),
        F.array(b.subject_of_lang(), F.when(i % 9 == 0, "maths").otherwise(SUBJECTS[0])).alias("subject_areas"),
        F.lit(1).alias("total_questions"),
    )
    question = F.struct(
        F.concat(F.lit("q"), i.cast("string")).alias("question_id"),
        F.lit("short_answer").alias("question_type"),
        F.when(i % 10 == 0, "maths").otherwise(b.subject_of_lang()).alias("subject_area"),
        (i % 8).alias("difficulty_level"),
        F.col("text").alias("question_text"),
        F.when(i % 11 != 10, F.struct(F.col("lang").alias("answer"))).alias("correct_answer"),
        F.struct(F.when(i % 6 != 0, 2).alias("points_possible"), F.array(F.struct(F.lit(2).alias("points"))).alias("scoring_criteria")).alias("scoring_rubric"),
    )
    body = F.to_json(F.struct(meta.alias("test_metadata"), F.array(question).alias("questions")))
    return d.select("doc_id", F.when(i % 17 == 0, F.concat(F.lit("{"), "text")).otherwise(body).alias("document"))


@query(
    "document_rules",
    f"with {DOCUMENT_RULES} select doc_id, array_to_string(list_sort(violations), ' | ') as violations from v",
)
def document_rules(spark, sf):
    v = docs.with_violations(_documents(spark, sf))
    return v.select("doc_id", joined(F.array_sort("violations"), "violations"))


@query(
    "valid_documents",
    f"""with {DOCUMENT_RULES} select v.doc_id, v.source as test_id, 0::bigint as question_no, 'q' || v.doc_id as question_id,
    (v.doc_id % 8)::bigint as difficulty_level, md5(text) as text_md5, true as count_matches
    from v join documents on documents.doc_id = v.doc_id where len(violations) = 0""",
)
def valid_documents(spark, sf):
    parsed = docs.parse_documents(_documents(spark, sf))
    flat = docs.flatten_questions(parsed, ("doc_id", "count_matches"))
    return flat.select(
        "doc_id",
        "test_id",
        big("question_no"),
        "question_id",
        big("difficulty_level"),
        F.md5("question_text").alias("text_md5"),
        "count_matches",
    )


@query(
    "flatten_questions",
    """select source || '-' || doc_id as test_id, (unnest(range(0, len(lines))))::bigint as question_no, md5(unnest(lines)) as text_md5
       from (select doc_id, source, string_split(text, chr(10)) as lines from documents)""",
)
def flatten_questions(spark, sf):
    d = b.table(spark, sf, "documents")
    lines = F.transform(F.split("text", "\n"), lambda t: F.struct(t.alias("question_text")))
    name = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    tests = d.select(F.struct(name.alias("test_id")).alias("test_metadata"), lines.alias("questions"))
    flat = docs.flatten_questions(tests)
    return flat.select("test_id", big("question_no"), F.md5("question_text").alias("text_md5"))


@query(
    "explode_responses",
    "select conv_id, 'Q' || turn as question_id, md5(text) as response_md5 from conversations",
)
def explode_responses(spark, sf):
    c = b.table(spark, sf, "conversations")
    name = F.concat(F.lit("Q"), F.col("turn").cast("string"))
    files = c.select("conv_id", F.to_json(F.create_map(name, F.col("text"))).alias("document"))
    return docs.explode_responses(files).select("conv_id", "question_id", F.md5("response").alias("response_md5"))


@query(
    "first_questions",
    """select source, lang, doc_id, n_chars from documents
       qualify row_number() over (partition by source, lang order by doc_id) = 1""",
)
def first_questions(spark, sf):
    d = b.table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars")
    return first_match(d, ["source", "lang"], "doc_id")
