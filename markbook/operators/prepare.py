"""Instruction-tuning examples from a question bank."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from markbook.config import DEFAULT, Config
from markbook.functions.common import has_items, is_blank, strip
from markbook.functions.text import word_tokens
from markbook.operators.quality import stimulus_text

# The two instruction layouts.
WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides "
    "further context. Write a response that appropriately completes the request."
)
WITHOUT_INPUT = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request."
)
TASKS = ("question_generation", "answer_generation", "rubric_generation")


def _named(cfg: Config) -> str:
    return f"Year 3 {cfg.programme} " if cfg.programme else "Year 3 "


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def question_instruction(cfg: Config = DEFAULT) -> Column:
    content = stimulus_text(F.col("stimulus"))
    return F.concat(
        F.lit("Generate a "),
        _text(F.col("question_type")),
        F.lit(f" question for {_named(cfg)}assessment.\n\nRequirements:\n- Subject area: "),
        _text(F.col("subject_area")),
        F.lit("\n- Difficulty level: "),
        _text(F.col("difficulty_level")),
        F.lit("/5\n- Learning objective: "),
        _text(F.col("learning_objective")),
        F.lit("\n- Appropriate for 8-9 year old students\n"),
        F.coalesce(F.concat(F.lit("\nStimulus text provided: "), content), F.lit("")),
    )


def question_output() -> Column:
    options = F.transform(
        "options", lambda o: F.concat(_text(o["option_id"]), F.lit(". "), _text(o["text"]))
    )
    listed = F.when(has_items(F.col("options")), F.array_join(options, "\n"))
    return strip(
        F.concat(
            F.lit("Question: "),
            _text(F.col("question_text")),
            F.lit("\n"),
            F.coalesce(F.concat(F.lit("Options:\n"), listed), F.lit("")),
        )
    )


def answer_instruction(cfg: Config = DEFAULT) -> Column:
    content = stimulus_text(F.col("stimulus"))
    return F.concat(
        F.coalesce(F.concat(F.lit("Based on this text:\n"), content, F.lit("\n\n")), F.lit("")),
        F.lit(f"Generate the correct answer and explanation for this {_named(cfg)}question:\n\n"),
        _text(F.col("question_text")),
    )


def answer_output() -> Column:
    key = F.col("correct_answer")
    explained = F.when(~is_blank(key["explanation"]), key["explanation"])
    variations = F.when(
        has_items(key["acceptable_variations"]), F.array_join(key["acceptable_variations"], ", ")
    )
    return strip(
        F.concat_ws(
            "\n",
            F.concat(F.lit("Answer: "), _text(key["answer"])),
            F.concat(F.lit("Explanation: "), explained),
            F.concat(F.lit("Acceptable variations: "), variations),
        )
    )


def rubric_instruction(cfg: Config = DEFAULT) -> Column:
    return F.concat(
        F.lit(f"Generate a scoring rubric for this {_named(cfg)}question:\n\n"),
        _text(F.col("question_text")),
    )


def rubric_output() -> Column:
    lines = F.transform(
        "scoring_rubric.scoring_criteria",
        lambda c: F.concat(_text(c["points"]), F.lit(" points: "), _text(c["criteria"])),
    )
    return strip(
        F.concat(
            F.lit("Points possible: "),
            _text(F.col("scoring_rubric.points_possible")),
            F.lit("\n\nScoring criteria:\n"),
            F.coalesce(F.array_join(lines, "\n"), F.lit("")),
        )
    )


def extract_examples(questions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Three examples per question, in one pass over the bank.

    Rows are tripled before the texts are written, so a query that needs only the
    keys reads and writes no text.
    """
    task = F.col("task_type")
    tripled = questions.withColumn("task_type", F.explode(F.array(*[F.lit(t) for t in TASKS])))
    by_task = lambda made, answer, rubric: (
        F.when(task == TASKS[0], made).when(task == TASKS[1], answer).otherwise(rubric)
    )
    return tripled.select(
        F.concat_ws("/", "test_id", "question_id", task).alias("example_id"),
        by_task(
            question_instruction(cfg), answer_instruction(cfg), rubric_instruction(cfg)
        ).alias("instruction"),
        F.lit("").alias("input"),
        by_task(question_output(), answer_output(), rubric_output()).alias("output"),
        task,
        "subject_area",
        F.when(task == TASKS[0], F.col("difficulty_level")).alias("difficulty_level"),
        "question_type",
    )


def eval_quotas(sizes: DataFrame, stratum: str, fraction: float) -> DataFrame:
    """Rows each stratum owes to the evaluation part, from its size ``n``.

    ceil(fraction * all) rows in total, shared out in proportion; what rounding
    down leaves over goes to the largest remainders (ties by name).  Works on one
    row per stratum.
    """
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    wanted = F.ceil(total * F.lit(fraction))
    exact = F.col("n") * wanted / total
    floored = sizes.withColumns({"__wanted": wanted, "__exact": exact}).withColumns(
        {"__floor": F.floor("__exact"), "__rest": F.col("__exact") - F.floor("__exact")}
    )
    order = Window.orderBy(F.desc("__rest"), stratum)
    short = F.col("__wanted") - F.sum("__floor").over(every)
    quota = F.col("__floor") + (F.row_number().over(order) <= short).cast("bigint")
    return floored.withColumn("quota", quota).select(stratum, "quota")


def stratified_split(
    examples: DataFrame,
    key: str = "example_id",
    stratum: str = "task_type",
    cfg: Config = DEFAULT,
    bucket_digits: int = 5,
) -> DataFrame:
    """Add ``split`` (train or eval): a seeded, stratified, exact split by a unique key.

    Rows are ordered by the hash of key and seed.  There are few strata, so
    ranking a whole stratum in one task would not scale; instead rows are counted
    per stratum and leading hash digits, the bucket where the quota falls is
    found from the counts, and only the rows of that bucket are ranked.  The
    outcome is one hash per stratum, read as a scalar, so the examples themselves
    are neither shuffled nor sorted.
    """
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(cfg.seed))))
    group = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    hashed = examples.select(
        group.alias("s"), digest.alias("h"), F.substring(digest, 1, bucket_digits).alias("b")
    )
    buckets = hashed.groupBy("s", "b").agg(F.count("*").alias("c"))
    quotas = eval_quotas(buckets.groupBy("s").agg(F.sum("c").alias("n")), "s", cfg.eval_fraction)
    running = F.sum("c").over(
        Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    )
    cut_buckets = (
        buckets.withColumn("upto", running)
        .join(quotas, "s")
        .filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("c") < F.col("quota")))
        .select("s", "b", (F.col("quota") - F.col("upto") + F.col("c")).alias("take"))
    )
    rank = F.row_number().over(Window.partitionBy("s", "b").orderBy("h"))
    cuts = (
        hashed.join(F.broadcast(cut_buckets), ["s", "b"])  # one row per stratum
        .withColumn("r", rank)
        .filter(F.col("r") == F.col("take"))
        .agg(F.map_from_entries(F.collect_list(F.struct("s", "h"))).alias("cuts"))
    )
    last = F.try_element_at(cuts.scalar(), group)
    return examples.withColumn(
        "split", F.when(F.coalesce(digest <= last, F.lit(False)), "eval").otherwise("train")
    )


STATISTICS = ("task_type", "subject_area", "difficulty_level", "question_type")


def split_statistics(split: DataFrame) -> DataFrame:
    """Sizes of both parts, and value counts of the training part, as a long table.

    One pass: rows are counted by all columns together, the small result by each.
    """
    names = [F.col(c).cast("string").alias(c) for c in STATISTICS]
    fine = split.select("split", *names).groupBy("split", *STATISTICS).agg(F.count("*").alias("n"))
    entry = lambda statistic, value: F.struct(
        F.lit(statistic).alias("statistic"), value.alias("value")
    )
    in_training = lambda c: F.when(F.col("split") == "train", F.col(c))
    entries = F.array(
        entry("examples", F.lit("total")),
        entry("examples", F.col("split")),
        *[entry(f"{c}_distribution", in_training(c)) for c in STATISTICS],
    )
    return (
        fine.select("n", F.inline(entries))
        .filter(F.col("value").isNotNull())
        .groupBy("statistic", "value")
        .agg(F.sum("n").alias("n"))
    )


def format_example(instruction: Column, given: Column, output: Column) -> Column:
    """One training text; examples with an input use the longer layout."""
    head = lambda first: F.concat(F.lit(f"{first}\n\n### Instruction:\n"), instruction)
    answer = F.concat(F.lit("\n\n### Response:\n"), output)
    return F.when(
        ~is_blank(given),
        F.concat(head(WITH_INPUT), F.lit("\n\n### Input:\n"), given, answer),
    ).otherwise(F.concat(head(WITHOUT_INPUT), answer))


def tokenize(
    df: DataFrame,
    text: str = "text",
    tokenize_fn: Callable[[list[str]], list[list[int]]] | None = None,
    cfg: Config = DEFAULT,
) -> DataFrame:
    """Add ``input_ids`` cut to ``max_tokens`` and ``labels`` equal to them.

    Without a tokenizer the ids are the word tokens themselves, found natively;
    a given tokenizer is called on Arrow batches of texts.
    """
    limit = cfg.max_tokens
    if tokenize_fn is None:
        ids = F.slice(word_tokens(F.coalesce(F.col(text), F.lit(""))), 1, limit)
    else:

        @F.pandas_udf(ArrayType(LongType()))
        def encode(texts: pd.Series) -> pd.Series:
            return pd.Series([row[:limit] for row in tokenize_fn(texts.fillna("").tolist())])

        ids = encode(F.col(text))
    return df.withColumn("input_ids", ids).withColumn("labels", F.col("input_ids"))
