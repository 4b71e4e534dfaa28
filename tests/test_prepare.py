from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import functions as F

from markbook.config import Config
from markbook.operators import prepare as pr
from markbook.sources import documents as docs


def examples_of(spark, sample, cfg=Config()):
    raw = spark.createDataFrame([(json.dumps(sample),)], "document string")
    return pr.extract_examples(docs.flatten_questions(docs.parse_documents(raw)), cfg)


def test_examples(spark, sample):
    rows = {r.example_id: r for r in examples_of(spark, sample).collect()}
    assert len(rows) == 12
    made = rows["REEF/reef-food/question_generation"]
    assert made.instruction == (
        "Generate a multiple_choice question for Year 3 assessment.\n\nRequirements:\n"
        "- Subject area: reading_comprehension\n- Difficulty level: 1/5\n"
        "- Learning objective: Take a fact from a sentence\n- Appropriate for 8-9 year old students\n"
        "\nStimulus text provided: Parrotfish scrape algae off the rocks all day long."
    )
    assert made.output == (
        "Question: Which food do parrotfish look for?\nOptions:\nA. Plankton\nB. Sea grass\nC. Shrimps\nD. Algae"
    )
    assert made.difficulty_level == 1 and made.input == ""
    answer = rows["REEF/reef-food/answer_generation"]
    assert answer.instruction == (
        "Based on this text:\nParrotfish scrape algae off the rocks all day long.\n\n"
        "Generate the correct answer and explanation for this Year 3 question:\n\nWhich food do parrotfish look for?"
    )
    assert answer.output == "Answer: D\nExplanation: The rocks are covered with algae."
    assert rows["REEF/reef-word/answer_generation"].output == (
        "Answer: it hunts and moves during the night\n"
        "Acceptable variations: awake at night, sleeps by daylight, night animal"
    )
    assert answer.difficulty_level is None
    assert rows["REEF/reef-verb/rubric_generation"].output == "Points possible: 2\n\nScoring criteria:\n2 points: A"
    # An objective that is not there leaves an empty place.
    assert "- Learning objective: \n" in rows["REEF/reef-essay/question_generation"].instruction


def test_programme_name_is_a_setting(spark, sample):
    rows = examples_of(spark, sample, Config(programme="Spring")).filter("task_type = 'rubric_generation'").collect()
    assert all(r.instruction.startswith("Generate a scoring rubric for this Year 3 Spring question:") for r in rows)


def test_split_of_the_sample(spark, sample):
    split = pr.stratified_split(examples_of(spark, sample))
    counts = {(r.task_type, r.split): r["count"] for r in split.groupBy("task_type", "split").count().collect()}
    assert counts == {
        ("answer_generation", "eval"): 1,
        ("answer_generation", "train"): 3,
        ("question_generation", "eval"): 1,
        ("question_generation", "train"): 3,
        ("rubric_generation", "eval"): 1,
        ("rubric_generation", "train"): 3,
    }
    stats = {(r.statistic, r.value): r.n for r in pr.split_statistics(split).collect()}
    assert stats["examples", "total"] == 12 and stats["examples", "eval"] == 3
    assert stats["task_type_distribution", "rubric_generation"] == 3
    assert sum(n for (s, _), n in stats.items() if s == "difficulty_level_distribution") == 3


def split_twin(rows, fraction, seed):
    """Quotas by largest remainder; within a stratum the smallest hashes go to eval."""
    n = len(rows)
    wanted = math.ceil(n * fraction)
    groups = {}
    for key, s in rows:
        groups.setdefault(s or "", []).append(hashlib.md5(f"{key}|{seed}".encode()).hexdigest())
    exact = {s: len(g) * wanted / n for s, g in groups.items()}
    quota = {s: math.floor(e) for s, e in exact.items()}
    left = wanted - sum(quota.values())
    for s in sorted(groups, key=lambda s: (-(exact[s] - quota[s]), s))[:left]:
        quota[s] += 1
    chosen = {h for s, g in groups.items() for h in sorted(g)[: quota[s]]}
    return {key for key, _ in rows if hashlib.md5(f"{key}|{seed}".encode()).hexdigest() in chosen}


def test_split_is_exact_seeded_and_skew_safe(spark):
    rows = [(i, "hot" if i % 3 else ("a", "b", None)[i % 7 % 3]) for i in range(2000)]
    df = spark.createDataFrame(rows, "example_id long, task_type string").repartition(7)
    for cfg, digits in ((Config(), 1), (Config(), 3), (Config(seed=7, eval_fraction=0.35), 2)):
        got = pr.stratified_split(df, cfg=cfg, bucket_digits=digits)
        chosen = {r.example_id for r in got.filter("split = 'eval'").collect()}
        assert chosen == split_twin(rows, cfg.eval_fraction, cfg.seed)
        assert got.count() == 2000


def test_layouts_and_tokens(spark):
    df = spark.createDataFrame([("do it", "", "yes"), ("do it", "here", "yes")], "a string, b string, c string")
    got = [r[0] for r in df.select(pr.format_example(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got[0] == f"{pr.WITHOUT_INPUT}\n\n### Instruction:\ndo it\n\n### Response:\nyes"
    assert got[1] == f"{pr.WITH_INPUT}\n\n### Instruction:\ndo it\n\n### Input:\nhere\n\n### Response:\nyes"
    text = spark.createDataFrame([("a b c, d",), (None,)], "text string")
    rows = pr.tokenize(text, cfg=Config(max_tokens=4)).collect()
    assert rows[0].input_ids == rows[0].labels == ["a", "b", "c", ","] and rows[1].input_ids == []
    given = pr.tokenize(text, tokenize_fn=lambda ts: [[len(w) for w in t.split()] for t in ts], cfg=Config(max_tokens=3))
    assert [r.input_ids for r in given.collect()] == [[1, 1, 2], []]
