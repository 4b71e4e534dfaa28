"""A quality classifier as a sparse ensemble of rules.

Trees are grown on text statistics; every path from a root is a rule, a
conjunction of comparisons.  A lasso logistic model picks and weighs the rules,
and the survivors become one Column expression, so scoring is a projection.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import stage, text_or_empty

THRESHOLD = 0.3
#: Labelled rows the model is fitted on, chosen by hash; all counts and statistics are of whole texts.
SAMPLE_ROWS = 20_000
TREES = 16
DEPTH = 3
LASSO = 0.001
SEED = 7


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each whole text, as doubles."""

    def without(pattern: str) -> Column:
        return F.length("body") - F.length(F.regexp_replace("body", pattern, ""))

    counted = docs.select("doc_id", text_or_empty("text").alias("body")).select(
        "doc_id",
        F.length("body").alias("chars"),
        without(r"\p{Lu}").alias("upper"),
        without(r"\p{L}").alias("letters"),
        without(r"[0-9]").alias("digits"),
        without(r"[#$%&*|!=+<>^~_@{}\[\]\\]").alias("symbols"),
        without(r"[.,;:?]").alias("stops"),
        without(r"\n").alias("lines"),
        F.filter(F.split("body", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
    )
    sized = counted.select(
        "*",
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size(F.filter(F.transform("words", lambda w, i: (i > 0) & (w == F.get("words", i - 1))), lambda x: x)).alias(
            "n_again"
        ),
        F.size(F.filter("words", lambda w: F.length(w) <= 3)).alias("n_short"),
    )
    words = F.col("n_words")
    return sized.select(
        "doc_id",
        F.log1p("chars").alias("log_chars"),
        _share(F.col("upper"), F.col("letters")).alias("upper"),
        _share(F.col("letters"), F.col("chars")).alias("letters"),
        _share(F.col("digits"), F.col("chars")).alias("digits"),
        _share(F.col("symbols"), F.col("chars")).alias("symbols"),
        _share(F.col("symbols"), words).alias("symbols_a_word"),
        _share(F.col("stops"), words).alias("stops"),
        _share(F.col("lines"), words).alias("lines"),
        _share(F.col("n_distinct"), words).alias("distinct"),
        _share(F.col("n_again"), words).alias("again"),
        _share(F.col("n_short"), words).alias("short"),
        _share(F.col("chars"), words).alias("word_length"),
    )


#: One comparison: feature, whether it must not exceed the bound, the bound.
Test = tuple[str, bool, float]
Rule = tuple[Test, ...]


@dataclass(frozen=True)
class RuleModel:
    """An intercept and weighted rules."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule) -> Column:
    tests = [F.col(name) <= bound if below else F.col(name) > bound for name, below, bound in rule]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


_TEST = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def paths(tree: str, names: list[str]) -> set[Rule]:
    """The conjunctions on all paths of a printed tree."""
    out: set[Rule] = set()
    stack: list[tuple[int, Test]] = []
    for line in tree.splitlines():
        found = _TEST.match(line)
        if not found:
            continue
        indent = len(found[1])
        while stack and stack[-1][0] >= indent:
            stack.pop()
        stack.append((indent, (names[int(found[2])], found[3] == "<=", float(found[4]))))
        out.add(tuple(sorted({test for _, test in stack})))
    return out


def fit(rows: DataFrame, names: list[str]) -> RuleModel:
    """Learn rules from rows with the statistics and a ``label`` of 0.0 or 1.0.

    With one label only, or no rows, the model is the share of label 1 (half without rows).
    """
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return RuleModel(8.0 if 1.0 in counts else -8.0 if counts else 0.0, ())
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", subsamplingRate=0.5
    ).fit(vectors)
    rules = sorted(set().union(*(paths(tree.toDebugString, names) for tree in forest.trees)))
    if not rules:
        share = counts[1.0] / (counts[0.0] + counts[1.0])
        return RuleModel(float(-math.log(1 / share - 1)), ())
    flags = [F.when(holds(rule), 1.0).otherwise(0.0).alias(f"rule_{i}") for i, rule in enumerate(rules)]
    table = VectorAssembler(inputCols=[f"rule_{i}" for i in range(len(rules))], outputCol="features").transform(
        rows.select("label", *flags)
    )
    lasso = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, standardization=True, maxIter=60).fit(
        table.select("label", "features")
    )
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(
        float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9)
    )


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Labels are learnt from rows that are not held out, at most about ``sample_rows``
    of them, chosen by a hash of the id; labels other than 0 and 1 are left out.
    Null and empty texts have statistics of zero and are scored like any other; a
    null id is not held out; repeated rows get equal scores; extra columns are ignored.

    Texts are read once: their statistics are staged, and labels join those narrow rows.
    """
    measured = stage(statistics(docs))
    names = [c for c in measured.columns if c != "doc_id"]
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = usable.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = usable.where(place < sample_rows / max(n, 1)).select("doc_id", F.col("quality").cast("double").alias("label"))
    # One order and layout of rows: the same rows give the same trees.
    rows = stage(
        measured.join(chosen, "doc_id").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id", "label", *names)
    )
    model = fit(rows, names)
    score = model.score()
    return measured.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        score.alias("score"),
        F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
