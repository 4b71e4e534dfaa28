"""Yearly runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import bindings as b
from checks import sql as s
from checks.generate_queries import GENERATED_FROM_PLAN, PLAN_OF_TESTS, _mix_rows, stand_in
from checks.registry import big, query, r6
from markbook.operators import generate as g
from markbook.operators import runs as rn
from markbook.plans.stage import shared_folder
from markbook.sources import years

CREATED = "2025-01-15T00:00:00"


@query(
    "variant_mixes",
    f"""with {b.RUNS_SQL}, m as (
      {' union all '.join(f"select '{d}' as dimension, * from {_mix_rows(d)}" for d in rn.DIMENSIONS)})
    select year, variant::bigint as variant, dimension, category, round(share, 6) as share, trunc(share * num_questions)::bigint as planned
    from run_variants join m using (variant)""",
)
def variant_mixes(spark, sf):
    v = rn.with_variant_mix(b.run_variants(spark, sf))
    planned = (F.col("share") * F.col("num_questions")).cast("bigint")
    return v.select(
        big("year"), big("variant"), "dimension", "category", r6("share"), planned.alias("planned")
    )


def _years(spark, sf):
    return b.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()


def _existing(spark, sf):
    return b.runs(spark, sf).filter(F.col("status").isNotNull())


@query(
    "annual_tests",
    f"""with {b.RUNS_SQL},
    fresh as (select distinct year(o_orderdate) as year from orders where year(o_orderdate) not in (select year from runs where status is not null))
    select year, v::bigint as variant, 'Y3_' || year || '_V' || lpad(v::varchar, 2, '0') || '_0115' as test_id
    from fresh, (select unnest(range(1, 4)) as v)""",
)
def annual_tests(spark, sf):
    fresh = rn.with_variants(rn.new_years(_years(spark, sf), _existing(spark, sf)), 3)
    name = g.test_name(F.col("year"), F.col("variant"), "0115")
    return fresh.select(big("year"), big("variant"), name.alias("test_id"))


def _year_plan(spark, sf):
    """A test per day with orders, in the variant of the day."""
    days = b.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return days.select(
        F.year("day").alias("year"),
        (F.dayofmonth("day") % 3 + 1).alias("variant"),
        F.concat_ws("-", F.lit("T"), F.col("day").cast("string")).alias("test_id"),
        (F.col("n") + 4).cast("int").alias("num_questions"),
    )


JUDGED_SQL = f"""{PLAN_OF_TESTS}, {GENERATED_FROM_PLAN},
flags as (select *, {s.indicators('lower(question_text)')} from measured),
scored as (select *, greatest(1::double, least(5::double,
    (case when q_grade <= 2 then 1 when q_grade <= 3 then 2 when q_grade <= 4 then 3 when q_grade <= 5 then 4 else 5 end)::double
    + (multi_step::int + inference_required::int + comparison_required::int + analysis_required::int) * 0.5::double
    + case question_type when 'multiple_choice' then 0::double when 'short_answer' then 0.5::double else 1::double end)) as estimated from flags),
judged as (select test_id, (case when q_ok then 1::double else 0.8::double end) * 0.3::double
    + (case when q_ok then 1::double else 0.5::double end) * 0.2::double + {s.topic_score('lower(question_text)', 'q_ok')} * 0.2::double
    + (1::double - abs(difficulty_level::double - estimated) / 5::double) * 0.15::double + 0.15::double as quality_score from scored)"""

SUITE_SQL = f"""
tests as (select 'T-' || strftime(o_orderdate, '%Y-%m-%d') as test_id, (count(*) + 4)::int as n,
    (day(any_value(o_orderdate)) % 3 + 1)::int as variant from orders group by strftime(o_orderdate, '%Y-%m-%d')),
{JUDGED_SQL},
results as (select substr(test_id, 3, 4)::bigint as year, test_id, count(*) as n, avg(quality_score) as quality from judged group by test_id)"""


@query(
    "annual_suite",
    f"""with recursive {SUITE_SQL} select year, count(*) as tests, sum(n)::bigint as questions, round(avg(quality), 6) as average_quality,
    round(min(quality), 6) as min_quality, round(max(quality), 6) as max_quality, round(var_pop(quality), 6) as quality_variance
    from results group by year""",
)
def annual_suite(spark, sf):
    """Generated questions of every day's test, evaluated and rolled up per year."""
    plan = g.question_plan(_year_plan(spark, sf))
    made = g.generate_questions(plan, stand_in, CREATED)
    tests, questions = F.count("*").alias("tests"), F.sum("num_questions").alias("questions")
    rolled = rn.variant_results(made).groupBy("year").agg(tests, questions, *rn.quality_aggregates())
    return rolled.select(
        big("year"), "tests", "questions", r6("average_quality"), r6("min_quality"), r6("max_quality"), r6("quality_variance")
    )


@query(
    "suite_runs",
    f"""with recursive tests as (select 'Y3_' || c_custkey || '_V' || lpad(v::varchar, 2, '0') || '_0115' as test_id, 20 as n, v::int as variant
      from customer, (select 1 as v) where c_custkey % 3 <> 0),
    {JUDGED_SQL},
    results as (select split_part(test_id, '_', 2)::bigint as year, test_id, avg(quality_score) as quality from judged group by test_id)
    select year, count(*) as num_variants, round(avg(quality), 6) as average_quality, round(min(quality), 6) as min_quality,
      round(max(quality), 6) as max_quality, round(var_pop(quality), 6) as quality_variance, 'completed' as status
    from results group by year""",
)
def suite_runs(spark, sf):
    """A test for each customer, as if each were a year; a third of them have their run already."""
    years = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("year"))
    suite = rn.annual_suite(years, years.where("year % 3 = 0"), stand_in, CREATED, "0115", variants=1)
    return suite.runs.select(
        big("year"), big("num_variants"), r6("average_quality"), r6("min_quality"), r6("max_quality"), r6("quality_variance"),
        "status",
    )


@query(
    "subject_shares",
    f"""with {b.ORDER_QUESTIONS_SQL}, c as (select year, variant, coalesce(subject_area, 'unknown') as subject_area, count(*) as n from order_questions group by all)
    select year, variant::bigint as variant, subject_area, n, round(n::double / sum(n) over (partition by year, variant), 6) as share from c""",
)
def subject_shares(spark, sf):
    s = rn.subject_shares(b.order_questions(spark, sf))
    return s.select(big("year"), big("variant"), "subject_area", "n", r6("share"))


@query(
    "difficulty_shares",
    f"""with {b.ORDER_QUESTIONS_SQL}, c as (select year, variant, 'level_' || coalesce(difficulty_level, 0) as level, count(*) as n from order_questions group by all)
    select year, variant::bigint as variant, level, n, round(n::double / sum(n) over (partition by year, variant), 6) as share from c""",
)
def difficulty_shares(spark, sf):
    s = rn.difficulty_shares(b.order_questions(spark, sf))
    return s.select(big("year"), big("variant"), "level", "n", r6("share"))


@query(
    "run_quality",
    f"""with {b.RUNS_SQL} select year, round(average_quality, 6) as average_quality, round(min_quality, 6) as min_quality,
    round(max_quality, 6) as max_quality, round(quality_variance, 6) as quality_variance from runs""",
)
def run_quality(spark, sf):
    r = rn.run_quality(b.run_variants(spark, sf))
    return r.select(
        big("year"), r6("average_quality"), r6("min_quality"), r6("max_quality"), r6("quality_variance")
    )


STATISTICS_SQL = """
stats as (select count(*) as years, sum(num_variants)::bigint as total_tests_generated,
    sum(num_variants * questions_per_test)::bigint as total_questions_generated,
    (select coalesce(avg(quality_score), 0) from run_variants where year in (select year from runs where status = 'completed')) as average_quality_score
  from runs)"""


@query(
    "overall_statistics",
    f"""with {b.RUNS_SQL}, {STATISTICS_SQL} select years, total_tests_generated, total_questions_generated,
    round(average_quality_score, 6) as average_quality_score from stats""",
)
def overall_statistics(spark, sf):
    o = rn.overall_statistics(b.runs(spark, sf), b.run_variants(spark, sf))
    return o.withColumn("average_quality_score", F.round("average_quality_score", 6))


@query(
    "year_status",
    f"""with {b.RUNS_SQL}, asked as (select distinct year(o_orderdate) + d as year from orders, (values (0), (3)) as v(d))
    select asked.year, coalesce(status, 'not_generated') as status, num_variants::bigint as num_variants from asked left join runs using (year)""",
)
def year_status(spark, sf):
    asked = _years(spark, sf).select(F.explode(F.array(F.col("year"), F.col("year") + 3)).alias("year"))
    s = rn.year_status(asked, b.runs(spark, sf))
    return s.select(big("year"), "status", big("num_variants"))


@query(
    "year_list",
    f"""with {b.RUNS_SQL} select year, coalesce(status, 'unknown') as status, num_variants::bigint as num_variants,
    round(average_quality, 6) as average_quality, generation_date from runs order by year desc""",
)
def year_list(spark, sf):
    return rn.list_years(b.runs(spark, sf)).select(
        big("year"), "status", big("num_variants"), r6("average_quality"), "generation_date"
    )


@query(
    "next_year",
    f"""with {b.RUNS_SQL} select (case when count(*) filter (year = 2001) > 0 then 2002 else 2001 end)::bigint as next_year from runs""",
)
def next_year(spark, sf):
    return rn.next_year(b.runs(spark, sf), 2001).select(big("next_year"))


@query(
    "tracking_summary",
    f"""with {b.RUNS_SQL}, {STATISTICS_SQL}
    select 'statistics' as section, 'all' as name, 'years' as field, years::double as number, null as word from stats
    union all select 'statistics', 'all', 'total_tests_generated', total_tests_generated::double, null from stats
    union all select 'statistics', 'all', 'total_questions_generated', total_questions_generated::double, null from stats
    union all select 'statistics', 'all', 'average_quality_score', round(average_quality_score, 6), null from stats
    union all select 'year', year::varchar, 'status', null, coalesce(status, 'unknown') from runs
    union all select 'year', year::varchar, 'num_variants', num_variants::double, null from runs
    union all select 'year', year::varchar, 'average_quality', round(average_quality, 6), null from runs
    union all select 'year', year::varchar, 'generation_date', null, generation_date from runs""",
)
def tracking_summary(spark, sf):
    t = rn.tracking_summary(b.runs(spark, sf), b.run_variants(spark, sf))
    number = F.when(~F.col("field").isin("status", "generation_date"), F.col("value").cast("double"))
    word = F.when(F.col("field").isin("status", "generation_date"), F.col("value"))
    return t.select("section", "name", "field", number.alias("number"), word.alias("word"))


@query(
    "annual_report",
    f"""with {b.RUNS_SQL}, {b.ORDER_QUESTIONS_SQL},
    c as (select year, variant, coalesce(subject_area, 'unknown') as subject_area, count(*) as n from order_questions group by all),
    sh as (select *, n::double / sum(n) over (partition by year, variant) as share from c),
    x as (select year, 'summary' as section, 0 as variant, 'num_variants' as metric, num_variants::double as value from runs
      union all select year, 'summary', 0, 'questions_per_test', questions_per_test::double from runs
      union all select year, 'summary', 0, 'average_quality', average_quality from runs
      union all select year, 'summary', 0, 'min_quality', min_quality from runs
      union all select year, 'summary', 0, 'max_quality', max_quality from runs
      union all select year, 'variant', variant, 'quality_score', quality_score from run_variants
      union all select year, 'subject_share', variant, subject_area, share from sh)
    select year, section, variant::bigint as variant, metric, round(value, 6) as value from x""",
)
def annual_report(spark, sf):
    r = rn.annual_report(
        b.runs(spark, sf), b.run_variants(spark, sf), rn.subject_shares(b.order_questions(spark, sf))
    )
    return r.select(big("year"), "section", big("variant"), "metric", r6("value"))


#: Which rows a year has when it is made again: a year divisible by three, and a better score.
REMADE_SQL = f"""{b.RUNS_SQL},
current as (select year, variant, num_questions, quality_score, null as archived_at from run_variants where year % 3 <> 0
  union all select year, variant, num_questions, quality_score * 0.5::double + 0.5::double, null from run_variants where year % 3 = 0),
archived as (select year, variant, num_questions, quality_score, 'second' as archived_at from run_variants where year % 3 = 0)"""


def _remade(spark, sf):
    """All years written, then a third of them made again."""
    path = f"{shared_folder(spark)}/years-{uuid.uuid4().hex}"
    rows = b.run_variants(spark, sf)
    years.replace_years(spark, rows, path, "first")
    better = F.col("quality_score") * 0.5 + 0.5
    years.replace_years(spark, rows.where("year % 3 = 0").withColumn("quality_score", better), path, "second", force=True)
    return path


@query(
    "remade_years",
    f"""with {REMADE_SQL} select year::bigint as year, variant::bigint as variant, num_questions, round(quality_score, 6) as quality_score, archived_at
    from (select * from current union all select * from archived)""",
)
def remade_years(spark, sf):
    """Current and archived rows after a third of the years were made again."""
    path = _remade(spark, sf)
    now = years.read_years(spark, path).withColumn("archived_at", F.lit(None).cast("string"))
    both = now.unionByName(years.read_archived(spark, path))
    return both.select(big("year"), big("variant"), "num_questions", r6("quality_score"), "archived_at")


@query(
    "kept_statistics",
    f"""with {REMADE_SQL} select count(*) as total_tests, sum(num_questions)::bigint as total_questions, round(avg(quality_score), 6) as average_quality,
      round(var_pop(quality_score), 6) as quality_variance, round(min(quality_score), 6) as min_quality, round(max(quality_score), 6) as max_quality from current""",
)
def kept_statistics(spark, sf):
    """Statistics over all years from the sums that were kept as years were replaced."""
    told = years.statistics(years.year_sums(spark, _remade(spark, sf)))
    measures = ("average_quality", "quality_variance", "min_quality", "max_quality")
    return told.select("total_tests", "total_questions", *map(r6, measures))
