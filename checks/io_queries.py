"""Round trips of whole tables through files in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import bindings as b
from checks.prepare_queries import EXAMPLES_SQL, _examples
from checks.registry import big, joined, query
from markbook.plans.positions import numbered_lines, zipped
from markbook.plans.stage import shared_folder
from markbook.sources import documents, schema, sinks, test_files


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(
    "jsonl_round_trip",
    f"""with {EXAMPLES_SQL} select md5(instruction) as instruction_md5, input, md5(output) as output_md5, task_type,
      subject_area, difficulty_level::bigint as difficulty_level, question_type from examples""",
)
def jsonl_round_trip(spark, sf):
    """All training examples, written as JSON lines by task and read again."""
    path = _folder(spark)
    examples = _examples(spark, sf)
    sinks.write_jsonl(examples.withColumn("part", F.col("task_type")), path, "part")
    back = documents.read_jsonl(spark, f"{path}/*")
    return back.select(
        F.md5("instruction").alias("instruction_md5"),
        "input",
        F.md5("output").alias("output_md5"),
        "task_type",
        "subject_area",
        big("difficulty_level"),
        "question_type",
    )


@query(
    "document_round_trip",
    """select source as test_id, (row_number() over (partition by source order by doc_id) - 1)::bigint as question_no,
      'q' || doc_id as question_id, md5(coalesce(text, '')) as question_md5, (doc_id % 5 + 1)::bigint as difficulty_level,
      'is ' || lang as answer, (doc_id % 4)::bigint as points_possible, 2000 + length(source) as year
      from documents""",
)
def document_round_trip(spark, sf):
    """A test of all texts of each source, each written as one document, read, checked and flattened by lines."""
    d = b.table(spark, sf, "documents")
    i = F.col("doc_id")
    questions = d.select(
        F.col("source").alias("test_id"),
        i.alias("question_no"),
        F.concat(F.lit("q"), i.cast("string")).alias("question_id"),
        F.lit("short_answer").alias("question_type"),
        F.lit("vocabulary").alias("subject_area"),
        (i % 5 + 1).cast("int").alias("difficulty_level"),
        F.coalesce("text", F.lit("")).alias("question_text"),
        F.struct(F.concat(F.lit("is "), "lang").alias("answer")).alias("correct_answer"),
        F.struct((i % 4).cast("int").alias("points_possible")).alias("scoring_rubric"),
    )
    tests = d.groupBy(F.col("source").alias("test_id")).agg(
        F.max(F.length("source") + 2000).alias("year"),
        F.lit("Year 3").alias("grade_level"),
        F.array(F.lit("vocabulary")).alias("subject_areas"),
        F.count("*").cast("int").alias("total_questions"),
    )
    path = _folder(spark)
    test_files.write_test_files(tests, questions, path)
    read, _ = test_files.read_test_files(spark, path)
    return read.where("count_matches").select(
        "test_id",
        big("question_no"),
        "question_id",
        F.md5("question_text").alias("question_md5"),
        big("difficulty_level"),
        F.col("correct_answer.answer").alias("answer"),
        big("scoring_rubric.points_possible", "points_possible"),
        big("test_metadata.year", "year"),
    )


#: The rules that turns of a conversation are to keep: a schema apart from the document format.
TURN_RULES = {
    "definitions": {"name": {"type": "string", "pattern": "^c[0-9]+$", "maxLength": 4}},
    "type": "object",
    "properties": {
        "id": {"$ref": "#/definitions/name"},
        "turn": {"type": "integer", "exclusiveMinimum": 0, "maximum": 5, "multipleOf": 2},
        "role": {"enum": ["user", "assistant", None]},
        "text": {"type": ["string", "null"], "minLength": 10},
        "words": {"type": "array", "items": {"type": "string", "maxLength": 12}, "minItems": 2, "maxItems": 2},
    },
    "required": ["id", "turn", "role"],
    "additionalProperties": False,
}


@query(
    "conversation_rules",
    """with c as (select conv_id, turn, role, text, 'c' || conv_id as id,
      list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')[1:2] as w from conversations)
    select conv_id, turn, array_to_string(list_sort(list_filter([
      case when not regexp_matches(id, '^c[0-9]+$') then 'id: does not match ^c[0-9]+$' end,
      case when length(id) > 4 then 'id: longer than 4' end,
      case when turn <= 0 then 'turn: not above 0' end, case when turn > 5 then 'turn: above 5' end,
      case when turn % 2 <> 0 then 'turn: not a multiple of 2' end,
      case when turn % 7 = 3 then 'role: missing' when role not in ('user', 'assistant') then 'role: not allowed' end,
      case when length(text) < 10 then 'text: shorter than 10' end,
      case when len(w) < 2 then 'words: fewer than 2' end,
      case when length(w[1]) > 12 then 'words[0]: longer than 12' end,
      case when length(w[2]) > 12 then 'words[1]: longer than 12' end,
      case when conv_id % 5 = 0 then 'extra: not allowed' end], lambda x: x is not null)), ' | ') as violations from c""",
)
def conversation_rules(spark, sf):
    """Every turn as JSON, checked against a schema of its own."""
    c = b.table(spark, sf, "conversations")
    words = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != ""), 1, 2)
    fields = F.struct(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"),
        F.col("turn").cast("double").alias("turn"),
        F.when(F.col("turn") % 7 != 3, F.col("role")).alias("role"),
        "text",
        words.alias("words"),
        F.when(F.col("conv_id") % 5 == 0, True).alias("extra"),
    )
    document = c.select("conv_id", "turn", F.to_json(fields).alias("document"))
    broken = schema.violations(TURN_RULES, "document")
    return document.select("conv_id", "turn", joined(F.array_sort(broken), "violations"))


@query(
    "zipped_scores",
    """with d as (select doc_id, length(coalesce(text, '')) as n, row_number() over (order by doc_id) - 1 as row_no from documents),
    l as (select quality, row_number() over (order by doc_id) - 1 as row_no from labels)
    select row_no::bigint as row_no, quality::bigint as human, (n % 2)::bigint as automatic,
      (quality = n % 2) as agreed from l join d using (row_no)""",
)
def zipped_scores(spark, sf):
    """Human and automatic scores in two files without keys, put side by side by their lines."""
    labels, docs = b.table(spark, sf, "labels"), b.table(spark, sf, "documents")
    human, automatic = _folder(spark), _folder(spark)
    score = F.length(F.coalesce("text", F.lit(""))) % 2
    labels.orderBy("doc_id").select(F.col("quality").cast("string")).write.text(human)
    docs.orderBy("doc_id").select(score.cast("string").alias("value")).write.text(automatic)
    left = numbered_lines(spark, human).select("row_no", F.col("value").cast("bigint").alias("human"))
    scored = left.agg(F.count(F.lit(1)).alias("rows"))
    right = numbered_lines(spark, automatic).select("row_no", F.col("value").cast("bigint").alias("automatic"))
    same = right.join(F.broadcast(scored), F.col("row_no") < F.col("rows")).drop("rows")  # one row
    both = zipped(left, same)
    return both.select("row_no", "human", "automatic", (F.col("human") == F.col("automatic")).alias("agreed"))
