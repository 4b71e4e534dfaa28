"""Instruction-tuning examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as b
from checks import sql as s
from checks.registry import big, query
from markbook.config import DEFAULT
from markbook.operators import prepare as pr

STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
N = "chr(10)"


def _text(x: str) -> str:
    return f"coalesce({x}::varchar, '')"


HAS_STIMULUS = "coalesce(stimulus_text, '') <> ''"
Q_INSTRUCTION = f"""'Generate a ' || question_type || ' question for Year 3 assessment.' || {N} || {N} || 'Requirements:' || {N}
  || '- Subject area: ' || subject_area || {N} || '- Difficulty level: ' || {_text('difficulty_level')} || '/5' || {N}
  || '- Learning objective: ' || {_text('learning_objective')} || {N} || '- Appropriate for 8-9 year old students' || {N}
  || case when {HAS_STIMULUS} then {N} || 'Stimulus text provided: ' || stimulus_text else '' end"""
Q_OUTPUT = STRIP.format(
    f"""'Question: ' || question_text || {N} || case when coalesce(len(options), 0) > 0
  then 'Options:' || {N} || array_to_string([o[1] || '. ' || o[2] for o in options], {N}) else '' end"""
)
A_INSTRUCTION = f"""case when {HAS_STIMULUS} then 'Based on this text:' || {N} || stimulus_text || {N} || {N} else '' end
  || 'Generate the correct answer and explanation for this Year 3 question:' || {N} || {N} || question_text"""
A_OUTPUT = STRIP.format(
    f"""'Answer: ' || {_text('answer')} || case when coalesce(explanation, '') <> '' then {N} || 'Explanation: ' || explanation else '' end
  || case when coalesce(len(variations), 0) > 0 then {N} || 'Acceptable variations: ' || array_to_string(variations, ', ') else '' end"""
)
R_INSTRUCTION = f"'Generate a scoring rubric for this Year 3 question:' || {N} || {N} || question_text"
R_OUTPUT = STRIP.format(
    f"""'Points possible: ' || {_text('points_possible')} || {N} || {N} || 'Scoring criteria:' || {N}
  || coalesce(array_to_string([coalesce(c.points::varchar, '') || ' points: ' || coalesce(c.criteria, '') for c in criteria], {N}), '')"""
)


def _example(task: str, instruction: str, output: str, level: str) -> str:
    return f"""select test_id || '/' || question_id || '/{task}' as example_id, {instruction} as instruction, '' as input,
      {output} as output, '{task}' as task_type, subject_area, {level} as difficulty_level, question_type from questions"""


EXAMPLES_SQL = f"""{b.QUESTIONS_SQL},
examples as ({_example(pr.TASKS[0], Q_INSTRUCTION, Q_OUTPUT, 'difficulty_level')}
  union all {_example(pr.TASKS[1], A_INSTRUCTION, A_OUTPUT, 'null')}
  union all {_example(pr.TASKS[2], R_INSTRUCTION, R_OUTPUT, 'null')})"""


def _examples(spark, sf):
    return pr.extract_examples(b.questions(spark, sf))


@query(
    "training_examples",
    f"""with {EXAMPLES_SQL} select example_id, md5(instruction) as instruction_md5, input, md5(output) as output_md5,
    task_type, subject_area, difficulty_level::bigint as difficulty_level, question_type from examples""",
)
def training_examples(spark, sf):
    return _examples(spark, sf).select(
        "example_id",
        F.md5("instruction").alias("instruction_md5"),
        "input",
        F.md5("output").alias("output_md5"),
        "task_type",
        "subject_area",
        big("difficulty_level"),
        "question_type",
    )


@query(
    "formatted_examples",
    f"""with {EXAMPLES_SQL},
    e as (select *, case when length(output) % 2 = 0 then subject_area else '' end as given from examples)
    select example_id, md5(case when given <> '' then '{pr.WITH_INPUT}' || {N} || {N} || '### Instruction:' || {N} || instruction
        || {N} || {N} || '### Input:' || {N} || given || {N} || {N} || '### Response:' || {N} || output
      else '{pr.WITHOUT_INPUT}' || {N} || {N} || '### Instruction:' || {N} || instruction || {N} || {N} || '### Response:' || {N} || output
      end) as text_md5 from e""",
)
def formatted_examples(spark, sf):
    given = F.when(F.length("output") % 2 == 0, F.col("subject_area")).otherwise("")
    text = pr.format_example(F.col("instruction"), given, F.col("output"))
    return _examples(spark, sf).select("example_id", F.md5(text).alias("text_md5"))


@query(
    "tokenized_examples",
    f"""with {EXAMPLES_SQL}, t as (select example_id, list_slice({s.tokens('output')}, 1, {DEFAULT.max_tokens}) as ids from examples)
    select example_id, len(ids)::bigint as n, md5(array_to_string(ids, ' ')) as ids_md5, true as same_labels from t""",
)
def tokenized_examples(spark, sf):
    t = pr.tokenize(_examples(spark, sf).select("example_id", F.col("output").alias("text")))
    return t.select(
        "example_id",
        big(F.size("input_ids"), "n"),
        F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
        (F.col("input_ids") == F.col("labels")).alias("same_labels"),
    )


def _split_sql(source: str, key: str, stratum: str) -> str:
    return f"""
sizes as (select coalesce({stratum}::varchar, '') as s, count(*) as n from {source} group by 1),
exact as (select s, n, ceil(sum(n) over ()::double * {DEFAULT.eval_fraction}::double) as wanted, sum(n) over () as total from sizes),
parts as (select s, n * wanted / total as e, floor(n * wanted / total) as f, wanted from exact),
quotas as (select s, f + (row_number() over (order by e - f desc, s) <= wanted - sum(f) over ())::int as quota from parts),
ranked as (select x.*, row_number() over (partition by coalesce({stratum}::varchar, '') order by md5({key}::varchar || '|{DEFAULT.seed}')) as r from {source} x),
split as (select ranked.*, case when r <= quota then 'eval' else 'train' end as split
  from ranked join quotas on quotas.s = coalesce({stratum}::varchar, ''))"""


@query(
    "stratified_split",
    f"with {EXAMPLES_SQL}, {_split_sql('examples', 'example_id', 'task_type')} select example_id, task_type, split from split",
)
def stratified_split(spark, sf):
    return pr.stratified_split(_examples(spark, sf)).select("example_id", "task_type", "split")


@query(
    "stratified_split_at_volume",
    f"with {_split_sql('events', 'event_id', 'event_type')} select event_id, event_type, split from split",
)
def stratified_split_at_volume(spark, sf):
    events = b.table(spark, sf, "events").select("event_id", "event_type")
    return pr.stratified_split(events, "event_id", "event_type")


def _statistic(column: str) -> str:
    return f"""select '{column}_distribution' as statistic, {column}::varchar as value, count(*) as n
      from split where split = 'train' and {column} is not null group by 2"""


@query(
    "split_statistics",
    f"""with {EXAMPLES_SQL}, {_split_sql('examples', 'example_id', 'task_type')}
    select 'examples' as statistic, 'total' as value, count(*) as n from split
    union all select 'examples', split, count(*) from split group by 2
    union all {' union all '.join(_statistic(c) for c in pr.STATISTICS)}""",
)
def split_statistics(spark, sf):
    return pr.split_statistics(pr.stratified_split(_examples(spark, sf)))
