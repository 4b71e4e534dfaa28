from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from markbook.operators import evaluation as ev
from markbook.operators import scoring as sc
from markbook.sources import documents as docs


def pairs_of(spark, human, machine, kind="cloze"):
    rows = [(i, kind, h, a) for i, (h, a) in enumerate(zip(human, machine))]
    df = spark.createDataFrame(rows, "question_no int, question_type string, human_score int, automated_score int")
    return ev.compare_scores(df)


def test_worked_agreement(spark):
    m = ev.agreement_metrics(pairs_of(spark, [2, 1, 0, 2, 1], [2, 0, 0, 2, 1])).first()
    assert m.total_comparisons == 5
    assert m.exact_agreement_rate == pytest.approx(0.8)
    assert m.within_one_point_agreement == 1.0
    assert m.mean_absolute_error == pytest.approx(0.2)
    assert m.correlation == pytest.approx(0.896421, abs=1e-6)
    assert m.cohens_kappa == pytest.approx(0.48 / 0.68)


def test_degenerate_agreement(spark):
    one = ev.agreement_metrics(pairs_of(spark, [1], [0])).first()
    assert one.correlation == 0.0
    same = ev.agreement_metrics(pairs_of(spark, [1, 1, 1], [1, 1, 1])).first()
    assert same.correlation is None and same.cohens_kappa is None and same.exact_agreement_rate == 1.0
    assert ev.agreement_metrics(pairs_of(spark, [], [])).count() == 0


def kappa_twin(x, y):
    n = len(x)
    po = sum(a == b for a, b in zip(x, y)) / n
    cx, cy = Counter(x), Counter(y)
    pe = sum(cx[k] * cy[k] for k in cx) / n**2
    return (po - pe) / (1 - pe)


def test_kappa_is_symmetric_and_equals_plain_python(spark):
    rng = random.Random(5)
    x = [rng.randint(0, 4) for _ in range(300)]
    y = [v if rng.random() < 0.6 else rng.randint(0, 4) for v in x]
    a = ev.agreement_metrics(pairs_of(spark, x, y)).first()
    b = ev.agreement_metrics(pairs_of(spark, y, x)).first()
    assert a.cohens_kappa == pytest.approx(b.cohens_kappa) == pytest.approx(kappa_twin(x, y))


def test_scoring_advice_lists_weak_types_in_order(spark):
    bad = pairs_of(spark, [0, 1, 2, 3], [3, 3, 0, 0], "cloze").withColumn("question_no", F.col("question_no") + 10)
    worse = pairs_of(spark, [0, 1], [4, 4], "matching")
    good = pairs_of(spark, [1, 2, 3], [1, 2, 3], "short_answer")
    r = ev.scoring_advice(bad.unionByName(worse).unionByName(good)).first()
    assert r.total_comparisons == 9
    assert r.recommendations[:4] == [ev.LOW_EXACT, ev.LOW_CORRELATION, ev.HIGH_ERROR, ev.LOW_KAPPA]
    assert [line.split()[3] for line in r.recommendations[4:]] == ["matching", "cloze"]


def test_balance(spark):
    rows = [("T", s, 4, t) for s, t in (("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"))] + [("U", None, None, None)]
    df = spark.createDataFrame(rows, "test_id string, subject_area string, difficulty_level int, question_type string")
    shares = ev.distribution(df).cache()
    total = {(r.test_id, r.dimension): r.s for r in shares.groupBy("test_id", "dimension").agg(F.sum("share").alias("s")).collect()}
    assert len(total) == 6 and all(v == pytest.approx(1) for v in total.values())
    unknown = {(r.dimension, r.category) for r in shares.filter("test_id = 'U'").collect()}
    assert unknown == {("subject", "unknown"), ("difficulty", "0"), ("question_type", "unknown")}
    b = {r.test_id: r for r in ev.balance(shares).collect()}
    assert b["T"].balance_score == pytest.approx(2 / (3 * math.log2(5)))
    assert b["U"].balance_score == 0.0


def test_agreement_detail_drops_unknown_questions(spark, sample):
    raw = spark.createDataFrame([(json.dumps(sample),)], "document string")
    bank = sc.prepare_bank(docs.flatten_questions(docs.parse_documents(raw)))
    human = spark.createDataFrame(
        [
            ("REEF", "reef-food", "D", 3),
            ("REEF", "reef-word", "a kind of fish", 3),
            ("REEF", "reef-none", "B", 1),
            ("REEF", "reef-essay", None, None),
        ],
        "test_id string, question_id string, student_response string, points_earned int",
    )
    got = {r.question_id: r for r in ev.agreement_detail(bank, human).collect()}
    assert sorted(got) == ["reef-essay", "reef-food", "reef-word"]
    assert got["reef-food"].agreement and got["reef-word"].difference == 3 and got["reef-essay"].human_score == 0


def test_report_rows(spark):
    df = spark.createDataFrame([(5, 0.5, ["x", "y"])], "n int, score double, recommendations array<string>")
    rows = [tuple(r) for r in ev.report_rows(df, "s", ["n", "score"]).orderBy("rank").collect()]
    assert rows == [
        ("s", 1, "n", 5.0, None),
        ("s", 2, "score", 0.5, None),
        ("s", 3, "recommendation", None, "x"),
        ("s", 4, "recommendation", None, "y"),
    ]
