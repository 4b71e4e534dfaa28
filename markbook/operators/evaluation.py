"""Quality of question sets, and agreement of automatic with human scores.

Every operator is a grouped aggregate.  Agreement is worked out from the table
of score pairs and their counts: the rows are read once, and what follows runs
on a few rows per group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markbook.config import DEFAULT, Config
from markbook.functions.common import message_if, messages, share
from markbook.operators.quality import is_high_quality, is_low_quality
from markbook.operators.scoring import score_responses

# Advice on question sets and on scoring.
LOW_OVERALL = "Overall question quality needs improvement. Focus on content appropriateness and clarity."
BAD_READING = "Many questions have inappropriate reading levels. Adjust vocabulary and sentence complexity for Year 3."
UNBALANCED = "Question distribution is unbalanced. Ensure even coverage across subjects and difficulty levels."
MANY_LOW = "Too many low-quality questions. Review and improve questions with quality scores below 0.6."
LOW_EXACT = "Exact agreement with human scorers is low. Review scoring criteria and algorithms."
LOW_CORRELATION = "Correlation with human scores is weak. Consider improving semantic similarity calculations."
HIGH_ERROR = "Mean absolute error is high. Review scoring rubrics for consistency."
LOW_KAPPA = "Inter-rater agreement (kappa) is moderate. Improve scoring reliability."

DIMENSIONS = ("subject", "difficulty", "question_type")
CATEGORIES_ASSUMED = 5


def quality_summary(evaluations: DataFrame, keys: tuple = ("test_id",)) -> DataFrame:
    """Means, spread and counts of question quality per group of ``evaluate_questions`` rows."""
    score, level = F.col("quality_score"), F.col("readability_metrics.readability_level")
    return evaluations.groupBy(*keys).agg(
        F.count("*").alias("total_questions"),
        F.avg(score).alias("average_quality_score"),
        F.stddev_pop(score).alias("quality_score_std"),
        F.avg(level).alias("average_readability"),
        F.avg(level.between(2.0, 4.0).cast("double")).alias("readability_appropriateness_rate"),
        F.avg("appropriateness_score").alias("average_appropriateness"),
        F.count_if(is_high_quality(score)).alias("high_quality_questions"),
        F.count_if(is_low_quality(score)).alias("low_quality_questions"),
        F.avg(score).alias("overall_quality_score"),
    )


CELL = ("subject_area", "difficulty_level", "question_type")


def quality_cells(evaluations: DataFrame, keys: tuple = ("test_id",)) -> DataFrame:
    """Sums of quality per group, subject, difficulty and type: what a report needs of
    the questions in one pass.  ``cell_summary`` and ``distribution`` take it from there.
    """
    score, level = F.col("quality_score"), F.col("readability_metrics.readability_level")
    cells = evaluations.withColumnRenamed("stated_difficulty", "difficulty_level")
    return cells.groupBy(*keys, *CELL).agg(
        F.count("*").alias("n"),
        F.sum(score).alias("score"),
        F.count_if(level.between(2.0, 4.0)).alias("readable"),
        F.count(level).alias("levels"),
        F.count_if(is_high_quality(score)).alias("high"),
        F.count_if(is_low_quality(score)).alias("low"),
    )


def cell_summary(cells: DataFrame, keys: tuple = ("test_id",)) -> DataFrame:
    """The part of ``quality_summary`` that advice and report are made of."""
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("total_questions"),
        (F.sum("score") / F.sum("n")).alias("average_quality_score"),
        (F.sum("readable") / F.nullif(F.sum("levels"), F.lit(0))).alias("readability_appropriateness_rate"),
        F.sum("high").alias("high_quality_questions"),
        F.sum("low").alias("low_quality_questions"),
    )


def distribution(questions: DataFrame, keys: tuple = ("test_id",), count: Column | None = None) -> DataFrame:
    """Count and share of every subject, difficulty and type per group, in one pass.

    Rows are counted by all three together first; only those counts are counted again
    by each.  ``count`` is how many questions a row stands for, one unless given.
    """
    named = (
        questions.select(
            *keys,
            F.coalesce("subject_area", F.lit("unknown")).alias("subject"),
            F.coalesce(F.col("difficulty_level").cast("string"), F.lit("0")).alias("difficulty"),
            F.coalesce("question_type", F.lit("unknown")).alias("question_type"),
            (F.lit(1) if count is None else count).cast("long").alias("__n"),
        )
        .groupBy(*keys, *DIMENSIONS)
        .agg(F.sum("__n").alias("__n"))
    )
    counted = named.groupingSets([[*keys, d] for d in DIMENSIONS], *keys, *DIMENSIONS).agg(
        F.grouping_id(*keys, *DIMENSIONS).alias("__level"), F.sum("__n").alias("n")
    )
    # A set bit marks a column that is not part of the grouping set: 011, 101, 110.
    level = F.col("__level")
    rows = counted.select(
        *keys,
        F.when(level == 3, "subject").when(level == 5, "difficulty").otherwise("question_type").alias("dimension"),
        F.when(level == 3, F.col("subject"))
        .when(level == 5, F.col("difficulty"))
        .otherwise(F.col("question_type"))
        .alias("category"),
        "n",
    )
    whole = Window.partitionBy(*keys, "dimension")
    return rows.withColumn("share", share(F.col("n"), F.sum("n").over(whole)))


def balance(shares: DataFrame, keys: tuple = ("test_id",)) -> DataFrame:
    """Entropy of each dimension in bits and their mean over log2(5)."""
    p = F.col("share")
    bits = lambda d: F.coalesce(
        -F.sum(F.when((F.col("dimension") == d) & (p > 0), p * F.log2(p))), F.lit(0.0)
    ) + F.lit(0.0)
    entropies = shares.groupBy(*keys).agg(*[bits(d).alias(f"{d}_entropy") for d in DIMENSIONS])
    top = F.lit(math.log2(CATEGORIES_ASSUMED))
    total = sum((F.col(f"{d}_entropy") / top for d in DIMENSIONS), F.lit(0.0))
    return entropies.withColumn("balance_score", total / F.lit(3.0))


def quality_advice(summary: DataFrame, balances: DataFrame, keys: tuple = ("test_id",)) -> DataFrame:
    """Advice on a question set from its summary and balance."""
    joined = summary.join(balances.select(*keys, "balance_score"), list(keys))
    return joined.withColumn(
        "recommendations",
        messages(
            message_if(F.col("average_quality_score") < 0.7, LOW_OVERALL),
            message_if(F.col("readability_appropriateness_rate") < 0.8, BAD_READING),
            message_if(F.col("balance_score") < 0.6, UNBALANCED),
            message_if(
                F.col("low_quality_questions") > F.col("total_questions") * F.lit(0.2), MANY_LOW
            ),
        ),
    )


def agreement_detail(bank: DataFrame, human: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Score the responses people have scored; one row per pair of scores.

    ``human`` has test_id, question_id, student_response and points_earned; scores
    of unknown questions are dropped.
    """
    given = human.select(
        "test_id",
        "question_id",
        F.coalesce("student_response", F.lit("")).alias("response"),
        F.coalesce("points_earned", F.lit(0)).alias("human_score"),
    )
    scored = score_responses(bank, given, cfg)
    return compare_scores(
        scored.withColumnRenamed("points_earned", "automated_score").select(
            "test_id", "question_id", "question_no", "question_type",
            "human_score", "automated_score", "confidence",
        )
    )


def compare_scores(pairs: DataFrame) -> DataFrame:
    """Add difference and agreement to rows of human_score and automated_score."""
    h, a = F.col("human_score"), F.col("automated_score")
    return pairs.withColumns({"difference": F.abs(h - a), "agreement": h == a})


def pair_counts(detail: DataFrame, keys: tuple = ()) -> DataFrame:
    """How often each pair of scores occurs."""
    return detail.groupBy(*keys, "human_score", "automated_score").agg(F.count("*").alias("n"))


def agreement_by_type(detail: DataFrame, keys: tuple = ()) -> DataFrame:
    """Share of equal scores per question type."""
    return detail.groupBy(*keys, "question_type").agg(
        F.avg(F.col("agreement").cast("double")).alias("agreement_rate"),
        F.count("*").alias("n"),
        F.min("question_no").alias("first_no"),
    )


def type_advice(question_type: Column) -> Column:
    return F.concat(
        F.lit("Scoring accuracy for "),
        question_type,
        F.lit(" questions is low. Review specific scoring logic."),
    )


# Sums over the counted pairs of scores; h and a stand for the two scores.
SUMS = ("n", "same", "near", "error", "h", "a", "hh", "aa", "ha")


def _label_sums(counts: DataFrame, keys: tuple, *more: Column) -> DataFrame:
    """Pair counts to one row per label (``kind`` label) and whatever ``more`` adds.

    Each pair counts once for its human label, with the sums, and once for its
    machine label; the product of both counts per label gives the agreement
    expected by chance.
    """
    h, a = F.col("human_score").cast("double"), F.col("automated_score").cast("double")
    n, none = F.col("n").cast("double"), F.lit(0.0)
    values = (
        n, (h == a).cast("double") * n, (F.abs(h - a) <= 1).cast("double") * n, F.abs(h - a) * n,
        h * n, a * n, h * h * n, a * a * n, h * a * n,
    )

    def side(label: Column, by_human: Column, by_machine: Column, counted: bool) -> Column:
        return F.struct(
            F.lit("label").alias("kind"),
            label.cast("string").alias("name"),
            by_human.alias("by_human"),
            by_machine.alias("by_machine"),
            *[(v if counted else none).alias(c) for c, v in zip(SUMS, values)],
            F.lit(None).cast("int").alias("first_no"),
        )

    rows = F.array(side(h, n, none, True), side(a, none, n, False), *more)
    return (
        counts.select(*keys, F.inline(rows))
        .groupBy(*keys, "kind", "name")
        .agg(
            *[F.sum(c).alias(c) for c in ("by_human", "by_machine", *SUMS)],
            F.min("first_no").alias("first_no"),
        )
    )


def _metrics(labels: DataFrame, keys: tuple, *more: Column) -> DataFrame:
    """Label rows to one row of metrics per group, with further aggregates."""
    label = F.col("kind") == "label"
    t = labels.groupBy(*keys).agg(
        F.sum(F.when(label, F.col("by_human") * F.col("by_machine"))).alias("chance"),
        *[F.sum(F.when(label, F.col(c))).alias(c) for c in SUMS],
        *more,
    )
    kept = [c for c in t.columns if c not in (*keys, "chance", *SUMS)]
    total = F.col("n")
    same, expected = F.col("same") / total, F.col("chance") / (total * total)
    cov = total * F.col("ha") - F.col("h") * F.col("a")
    var_h = total * F.col("hh") - F.col("h") * F.col("h")
    var_a = total * F.col("aa") - F.col("a") * F.col("a")
    none = F.lit(0.0)
    spread = F.nullif(F.sqrt(var_h) * F.sqrt(var_a), none)
    return t.filter(total > 0).select(
        *keys,
        total.cast("bigint").alias("total_comparisons"),
        same.alias("exact_agreement_rate"),
        F.when(total <= 1, 0.0).otherwise(cov / spread).alias("correlation"),
        (F.col("error") / total).alias("mean_absolute_error"),
        ((same - expected) / F.nullif(F.lit(1.0) - expected, none)).alias("cohens_kappa"),
        (F.col("near") / total).alias("within_one_point_agreement"),
        *kept,
    )


def agreement_metrics(detail: DataFrame, keys: tuple = ()) -> DataFrame:
    """Exact and within-one agreement, mean error, correlation and kappa per group.

    Correlation is 0 for a single pair and null if either side is constant; kappa
    is null if all scores are the same.
    """
    return _metrics(_label_sums(pair_counts(detail, keys), keys), keys)


def scoring_advice(detail: DataFrame, keys: tuple = ()) -> DataFrame:
    """Metrics with advice: overall lines, then weak question types in test order.

    One pass over the detail: question types are counted along with the labels.
    One line per weak type is gathered, so groups stay tiny.
    """
    counts = detail.groupBy(*keys, "question_type", "human_score", "automated_score").agg(
        F.count("*").alias("n"), F.min("question_no").cast("int").alias("first_no")
    )
    n, none = F.col("n").cast("double"), F.lit(0.0)
    equal = (F.col("human_score") == F.col("automated_score")).cast("double")
    of_type = F.struct(
        F.lit("type").alias("kind"),
        F.col("question_type").alias("name"),
        none.alias("by_human"),
        none.alias("by_machine"),
        *[{"n": n, "same": equal * n}.get(c, none).alias(c) for c in SUMS],
        F.col("first_no").alias("first_no"),
    )
    weak = (F.col("kind") == "type") & (F.col("same") / F.col("n") < 0.7)
    lines = F.array_sort(
        F.collect_list(F.when(weak, F.struct("first_no", type_advice(F.col("name")).alias("text"))))
    )
    metrics = _metrics(_label_sums(counts, keys, of_type), keys, lines.alias("__weak"))
    overall = messages(
        message_if(F.col("exact_agreement_rate") < 0.8, LOW_EXACT),
        message_if(F.col("correlation") < 0.7, LOW_CORRELATION),
        message_if(F.col("mean_absolute_error") > 1.0, HIGH_ERROR),
        message_if(F.col("cohens_kappa") < 0.6, LOW_KAPPA),
    )
    weak_lines = F.transform("__weak", lambda w: w["text"])
    return metrics.withColumn("recommendations", F.concat(overall, weak_lines)).drop("__weak")


def report_rows(df: DataFrame, section: str, metrics: list[str], keys: tuple = ()) -> DataFrame:
    """Long form of a wide table: one row (section, metric, value, rank) per metric and advice."""
    values = F.array(
        *[
            F.struct(
                F.lit(rank).alias("rank"),
                F.lit(metric).alias("metric"),
                F.col(metric).cast("double").alias("value"),
                F.lit(None).cast("string").alias("text"),
            )
            for rank, metric in enumerate(metrics, 1)
        ]
    )
    if "recommendations" in df.columns:
        advice = F.transform(
            "recommendations",
            lambda text, i: F.struct(
                (i + len(metrics) + 1).alias("rank"),
                F.lit("recommendation").alias("metric"),
                F.lit(None).cast("double").alias("value"),
                text.alias("text"),
            ),
        )
        values = F.concat(values, advice)
    return df.select(*keys, F.lit(section).alias("section"), F.inline(values))


QUALITY_REPORT = [
    "total_questions",
    "average_quality_score",
    "high_quality_questions",
    "low_quality_questions",
    "readability_appropriateness_rate",
]
AGREEMENT_REPORT = [
    "total_comparisons",
    "exact_agreement_rate",
    "correlation",
    "mean_absolute_error",
    "cohens_kappa",
]
