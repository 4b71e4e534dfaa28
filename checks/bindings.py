"""The engine's entities derived from the test tables, in Spark and in SQL.

``documents`` stand for questions, ``conversations`` for questions and the
responses to them, ``lineitem`` for scored items, ``orders`` for yearly runs.
Each Spark frame has an SQL twin giving the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.config import QUESTION_TYPES
from markbook.sources.tables import read_table, spread


# Tables whose queries do heavy work per row.
WORKED = {"documents", "conversations", "customer"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = read_table(spark, f"{sf}/{name}.parquet")
    return spread(df) if name in WORKED else df


QUESTIONS = """
  test_id string, question_no int, question_id string, question_type string, subject_area string,
  difficulty_level int, learning_objective string,
  stimulus struct<type:string,content:string,title:string>, question_text string,
  options array<struct<option_id:string,text:string>>,
  correct_answer struct<answer:string,explanation:string,acceptable_variations:array<string>>,
  scoring_rubric struct<points_possible:int,scoring_criteria:array<struct<points:int,criteria:string>>>,
  tags array<string>
"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a question; optional parts vary with the document id."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    nth = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), (i % by).cast("int"))
    option = lambda name, text: F.struct(F.lit(name).alias("option_id"), text.alias("text"))
    criteria = lambda *rows: F.array(
        *[
            F.struct(F.lit(p).cast("int").alias("points"), F.lit(c).alias("criteria"))
            for p, c in rows
        ]
    )
    no_criteria = F.lit(None).cast("array<struct<points:int,criteria:string>>")
    rubric = lambda points, rows: F.struct(
        F.lit(points).cast("int").alias("points_possible"), rows.alias("scoring_criteria")
    )
    rubrics = (
        F.when(i % 6 == 1, rubric(2, criteria((2, "full"), (1, "part"), (0, "none"))))
        .when(i % 6 == 2, rubric(2, criteria((1, "x"))))
        .when(i % 6 == 3, rubric(None, F.array().cast("array<struct<points:int,criteria:string>>")))
        .when(i % 6 == 4, rubric(4, no_criteria))
        .when(i % 6 == 5, rubric(3, criteria((3, "all"), (None, " "), (0, ""))))
    )
    stimulus = lambda kind, content: F.struct(
        F.lit(kind).alias("type"), content.alias("content"), F.lit(None).cast("string").alias("title")
    )
    return d.select(
        F.col("source").alias("test_id"),
        i.alias("question_no"),
        F.concat(F.lit("q"), i.cast("string")).alias("question_id"),
        nth(QUESTION_TYPES, 5).alias("question_type"),
        subject_of_lang().alias("subject_area"),
        F.when(i % 7 != 6, i % 5 + 1).cast("int").alias("difficulty_level"),
        F.when(i % 3 == 1, "").when(i % 3 == 2, F.concat(F.lit("objective "), "source")).alias("learning_objective"),
        F.when(i % 4 == 1, stimulus("none", F.lit(None).cast("string")))
        .when(i % 4 == 2, stimulus("text", F.col("text")))
        .when(i % 4 == 3, stimulus("text", F.lit("")))
        .alias("stimulus"),
        F.col("text").alias("question_text"),
        F.when(i % 15 == 0, F.array(option("A", F.col("lang"))))
        .when(
            i % 5 == 0,
            F.array(
                option("A", F.col("lang")),
                option("B", F.col("source")),
                option("C", F.concat(F.lit("n"), F.col("n_chars").cast("string"))),
                option("D", F.lit("none")),
            ),
        )
        .alias("options"),
        F.when(
            i % 11 != 10,
            F.struct(
                F.col("source").alias("answer"),
                F.when(i % 2 == 1, F.concat(F.lit("See "), "lang")).alias("explanation"),
                F.when(i % 3 == 0, F.array("lang", "source")).alias("acceptable_variations"),
            ),
        ).alias("correct_answer"),
        rubrics.alias("scoring_rubric"),
        F.when(i % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


def subject_of_lang():
    return (
        F.when(F.col("lang") == "en", "reading_comprehension")
        .when(F.col("lang") == "fr", "vocabulary")
        .when(F.col("lang") == "de", "writing")
        .otherwise("language_conventions")
    )


SUBJECT_OF_LANG = (
    "case lang when 'en' then 'reading_comprehension' when 'fr' then 'vocabulary' "
    "when 'de' then 'writing' else 'language_conventions' end"
)
TYPE_OF_ID = (
    "['multiple_choice','short_answer','extended_response','cloze','matching'][doc_id % 5 + 1]"
)

QUESTIONS_SQL = f"""
questions as (
  select source as test_id, doc_id as question_no, 'q' || doc_id as question_id,
    {TYPE_OF_ID} as question_type, {SUBJECT_OF_LANG} as subject_area,
    case when doc_id % 7 <> 6 then doc_id % 5 + 1 end as difficulty_level,
    case doc_id % 3 when 1 then '' when 2 then 'objective ' || source end as learning_objective,
    case when doc_id % 4 = 2 then text end as stimulus_text,
    text as question_text,
    case when doc_id % 15 = 0 then [['A', lang]]
         when doc_id % 5 = 0 then [['A', lang], ['B', source], ['C', 'n' || n_chars], ['D', 'none']]
    end as options,
    doc_id % 11 <> 10 as has_answer,
    case when doc_id % 11 <> 10 then source end as answer,
    case when doc_id % 11 <> 10 and doc_id % 2 = 1 then 'See ' || lang end as explanation,
    case when doc_id % 11 <> 10 and doc_id % 3 = 0 then [lang, source] end as variations,
    doc_id % 6 <> 0 as has_rubric,
    case doc_id % 6 when 1 then 2 when 2 then 2 when 4 then 4 when 5 then 3 end as points_possible,
    case doc_id % 6
      when 1 then [{{'points': 2, 'criteria': 'full'}}, {{'points': 1, 'criteria': 'part'}}, {{'points': 0, 'criteria': 'none'}}]
      when 2 then [{{'points': 1, 'criteria': 'x'}}]
      when 3 then []
      when 5 then [{{'points': 3, 'criteria': 'all'}}, {{'points': null, 'criteria': ' '}}, {{'points': 0, 'criteria': ''}}]
    end as criteria,
    case when doc_id % 2 = 0 then [lang, source] else [] end as tags,
    doc_id, lang, source
  from documents)
"""


def dialogue(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as questions, with the assistant's next turn as the response or null."""
    c = table(spark, sf, "conversations")
    asked = c.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question_text")
    )
    said = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(said, ["conv_id", "turn"], "left")


DIALOGUE_SQL = """
dialogue as (
  select u.conv_id, u.turn, u.text as question_text, a.text as response
  from conversations u left join conversations a
    on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
  where u.role = 'user')
"""


def dialogue_bank(spark: SparkSession, sf: str, types=("multiple_choice", "extended_response")) -> DataFrame:
    """A question bank: one test per conversation, one question per user turn."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    turn, n = F.col("turn"), (F.col("conv_id") + F.floor(F.col("turn") / 2)) % len(types)
    kind = F.get(F.array(*[F.lit(t) for t in types]), n.cast("int"))
    choice = kind == "multiple_choice"
    criterion = lambda p: F.struct(F.lit(p).alias("points"), F.lit("c").alias("criteria"))
    return c.select(
        F.col("conv_id").cast("string").alias("test_id"),
        turn.cast("int").alias("question_no"),
        turn.cast("string").alias("question_id"),
        kind.alias("question_type"),
        F.when((F.col("conv_id") + turn) % 3 == 0, "reading_comprehension")
        .when((F.col("conv_id") + turn) % 3 == 1, "writing")
        .otherwise("spelling")
        .alias("subject_area"),
        F.col("text").alias("question_text"),
        F.struct(
            F.when(choice, F.char(65 + F.col("conv_id") % 4)).otherwise(F.col("text")).alias("answer"),
            F.when(turn % 4 == 0, "Read again.").alias("explanation"),
            F.lit(None).cast("array<string>").alias("acceptable_variations"),
        ).alias("correct_answer"),
        F.struct(
            F.when(choice, 1).otherwise(4).alias("points_possible"),
            F.when(choice, F.array(criterion(1), criterion(0)))
            .otherwise(F.array(criterion(4), criterion(2), criterion(0)))
            .alias("scoring_criteria"),
        ).alias("scoring_rubric"),
    )


def dialogue_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as responses of one student per conversation."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    return c.select(
        F.concat(F.lit("s"), (F.col("conv_id") % 50).cast("string")).alias("student_id"),
        F.col("conv_id").cast("string").alias("test_id"),
        (F.col("turn") - 1).cast("string").alias("question_id"),
        F.col("text").alias("response"),
    )


DIALOGUE_BANK_SQL = """
bank as (
  select conv_id::varchar as test_id, turn::int as question_no, turn::varchar as question_id,
    ['multiple_choice', 'extended_response'][(conv_id + turn // 2) % 2 + 1] as question_type,
    case (conv_id + turn) % 3 when 0 then 'reading_comprehension' when 1 then 'writing' else 'spelling' end as subject_area,
    text as question_text,
    chr((65 + conv_id % 4)::int) as key_letter,
    case when turn % 4 = 0 then 'Read again.' end as explanation,
    case when (conv_id + turn // 2) % 2 = 0 then 1 else 4 end as points_possible
  from conversations where role = 'user'),
responses as (
  select 's' || (conv_id % 50) as student_id, conv_id::varchar as test_id,
    (turn - 1)::varchar as question_id, text as response
  from conversations where role = 'assistant')
"""


def scored_items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as scored items: student, test, subject, type and points."""
    li = table(spark, sf, "lineitem")
    earned = F.floor(F.col("l_quantity") * (1 - F.col("l_discount") * 8))
    return li.select(
        F.col("l_suppkey").alias("student_id"),
        (F.col("l_orderkey") % 4).alias("test_id"),
        F.col("l_linenumber").alias("question_no"),
        F.when(F.col("l_returnflag") == "A", "reading_comprehension")
        .when(F.col("l_returnflag") == "N", "vocabulary")
        .otherwise("spelling")
        .alias("subject_area"),
        F.when(F.col("l_linestatus") == "F", "multiple_choice").otherwise("cloze").alias("question_type"),
        F.col("l_quantity").cast("bigint").alias("points_possible"),
        earned.cast("bigint").alias("points_earned"),
        (earned >= F.col("l_quantity") * F.lit(0.6)).alias("is_correct"),
    )


SCORED_ITEMS_SQL = """
items as (
  select l_suppkey as student_id, l_orderkey % 4 as test_id, l_linenumber as question_no,
    case l_returnflag when 'A' then 'reading_comprehension' when 'N' then 'vocabulary' else 'spelling' end as subject_area,
    case l_linestatus when 'F' then 'multiple_choice' else 'cloze' end as question_type,
    l_quantity::bigint as points_possible,
    floor(l_quantity * (1 - l_discount * 8))::bigint as points_earned,
    floor(l_quantity * (1 - l_discount * 8)) >= l_quantity * 0.6::double as is_correct
  from lineitem)
"""


def run_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by year and variant: size and a quality score between 0 and 1."""
    o = table(spark, sf, "orders")
    return o.groupBy(
        F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 3 + 1).cast("int").alias("variant")
    ).agg(
        F.count("*").alias("num_questions"),
        (F.avg("o_totalprice") / F.lit(500000.0)).alias("quality_score"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly runs made from the variants; even years are completed."""
    from markbook.operators.runs import run_quality

    v = run_variants(spark, sf)
    counts = v.groupBy("year").agg(F.count("*").cast("int").alias("num_variants"))
    return counts.join(run_quality(v), "year").select(
        "*",
        F.concat(F.col("year").cast("string"), F.lit("-01-15")).alias("generation_date"),
        F.lit(20).alias("questions_per_test"),
        F.when(F.col("year") % 2 == 0, "completed").when(F.col("year") % 4 == 1, "in_progress").alias("status"),
    )


RUNS_SQL = """
run_variants as (
  select year(o_orderdate) as year, (o_custkey % 3 + 1)::int as variant,
    count(*) as num_questions, avg(o_totalprice) / 500000.0::double as quality_score
  from orders group by all),
runs as (
  select year, count(*) as num_variants, avg(quality_score) as average_quality,
    min(quality_score) as min_quality, max(quality_score) as max_quality,
    var_pop(quality_score) as quality_variance, year || '-01-15' as generation_date,
    20 as questions_per_test,
    case when year % 2 = 0 then 'completed' when year % 4 = 1 then 'in_progress' end as status
  from run_variants group by year)
"""


def order_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as generated questions of a year and variant."""
    o = table(spark, sf, "orders")
    return o.select(
        F.year("o_orderdate").alias("year"),
        (F.col("o_custkey") % 3 + 1).cast("int").alias("variant"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("subject_area"),
        F.when(F.col("o_orderkey") % 6 != 5, F.col("o_orderkey") % 6).cast("int").alias("difficulty_level"),
    )


ORDER_QUESTIONS_SQL = """
order_questions as (
  select year(o_orderdate) as year, (o_custkey % 3 + 1)::int as variant,
    case when o_orderpriority <> '5-LOW' then o_orderpriority end as subject_area,
    case when o_orderkey % 6 <> 5 then o_orderkey % 6 end as difficulty_level
  from orders)
"""


def planned_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as tests to be planned: 1 to 40 questions, variants 1 to 4."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("test_id"),
        (F.col("c_custkey") % 40 + 1).cast("int").alias("num_questions"),
        (F.col("c_custkey") % 4 + 1).cast("int").alias("variant"),
    )


PLANNED_TESTS_SQL = """
tests as (
  select c_custkey as test_id, (c_custkey % 40 + 1)::int as n, (c_custkey % 4 + 1)::int as variant
  from customer)
"""
