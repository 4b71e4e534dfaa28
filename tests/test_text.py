from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markbook.functions import text as tx


def tokens_twin(text):
    """The token contract in plain Python (ASCII texts)."""
    text = re.sub(r"(?i)([a-z])(n't)\b", r"\1 \2", text)
    text = re.sub(r"(?i)('(?:s|re|ve|ll|d|m))\b", r" \1", text)
    pattern = (
        r"\.\.\.|--|(?i:n't)\b|'(?i:s|re|ve|ll|d|m)\b"
        r"|[A-Za-z0-9]+(?:[-'.,][A-Za-z0-9]+)*|[^\sA-Za-z0-9]"
    )
    return re.findall(pattern, text)


def syllables_twin(word):
    groups = re.findall("[aeiouy]+", word.lower())
    n = len(groups) - (1 if word.lower().endswith("e") and len(groups) > 1 else 0)
    return max(1, n)


def sentences_twin(text):
    ends = len(re.findall(r"[.!?]+(?:[ \t\n\x0b\f\r]|\Z)", text))
    rest = text.rstrip(" \t\n\x0b\f\r")
    return ends + (1 if rest and rest[-1] not in ".!?" else 0)


def measured(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    df = tx.with_metrics(df, F.col("text"), "q").withColumn("t", tx.word_tokens(F.col("text")))
    m = tx.metrics_of("q")
    return df.select("*", tx.readability(m).alias("grade")).orderBy("i").collect()


def test_clean_text(spark):
    df = spark.createDataFrame([("  Hello,   world!  ",), ("a \tb @#$% cé_1",)], "t string")
    got = [r[0] for r in df.select(tx.clean_text(F.col("t"))).collect()]
    assert got == ["Hello, world!", "a b  cé_1"]


def test_tokens_split_contractions_and_punctuation(spark):
    rows = measured(spark, ["Don't we're JOHN'S well-known 3.5 -- ok... (yes)", "", "  \n "])
    assert rows[0].t == [
        "Do", "n't", "we", "'re", "JOHN", "'S", "well-known", "3.5", "--", "ok", "...", "(", "yes", ")",
    ]
    assert [(r.q_words, r.q_sentences, r.grade) for r in rows[1:]] == [(0, 0, 0.0), (0, 0, 0.0)]


def test_readability_worked_example(spark):
    rows = measured(
        spark, ["The cat sat on the mat. It was happy.", "Emma loves to read books about animals."]
    )
    assert (rows[0].q_words, rows[0].q_sentences, rows[0].q_syllables, rows[0].grade) == (11, 2, 12, 0.0)
    assert (rows[1].q_words, rows[1].q_sentences) == (8, 1)
    assert rows[1].grade == pytest.approx(6.705)


def test_word_syllables(spark):
    df = spark.createDataFrame([(w,) for w in ("the", "make", "happy", ".", "eye", "Queue")], "w string")
    got = [r[0] for r in df.select(tx.count_syllables(F.col("w"))).collect()]
    assert got == [1, 1, 2, 1, 1, 1]


ALPHABET = "aeiouybcnstrdlmveE'.,!?- \n1_()x"


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=60, max_size=60))
def test_counts_equal_plain_python(spark, texts):
    for row, text in zip(measured(spark, texts), texts):
        words = tokens_twin(text)
        assert row.t == words
        assert row.q_sentences == sentences_twin(text)
        assert row.q_syllables == sum(syllables_twin(w) for w in words)
        if words:
            grade = 0.39 * len(words) / row.q_sentences + 11.8 * row.q_syllables / len(words) - 15.59
            assert row.grade == pytest.approx(max(0.0, grade))


def test_long_runs_stay_linear(spark):
    rows = measured(spark, ["!" * 200_000 + "x", "a" * 200_000, " " * 200_000 + "a.", "e " * 100_000])
    assert [r.q_sentences for r in rows] == [1, 1, 1, 1]
    assert rows[3].q_syllables == 100_000


def test_age_check_and_advice(spark):
    df = spark.createDataFrame([("Emma loves to read books about animals.",), ("",)], "t string")
    m = tx.measure(F.col("t"))
    got = df.select(tx.age_check(tx.readability(m), m).alias("c")).collect()
    assert got[0].c.is_appropriate is False and got[0].c.recommendations == [tx.TOO_COMPLEX]
    assert got[1].c.word_count == 0 and got[1].c.recommendations == [tx.TOO_SIMPLE]


def test_topic_score_and_lowering(spark):
    df = spark.createDataFrame([("scary death of a friend's family",), ("violence adult death scary complex politics",)], "t string")
    got = [r[0] for r in df.select(tx.topic_score(F.lower("t"), F.lit(True))).collect()]
    assert got == [pytest.approx(0.6), 0.0]
    # A dotted capital I becomes two characters in lower case, the second a token of its own.
    df = spark.createDataFrame([("İa bc de fg.",)], "t string")
    low = tx.measure(F.lower("t"))
    again = tx.is_age_appropriate(tx.readability(low), tx.average_sentence_length(low), low.words)
    row = df.select(again, tx.appropriate_when_lowered(F.col("t"), ~again)).first()
    assert row[0] == row[1]


def test_organization_and_language(spark):
    df = spark.createDataFrame(
        [("One thing.",), ("First this. Then that.",), ("A b. C d. E f.",)], "t string"
    )
    got = [r[0] for r in df.select(tx.organization_score(F.lower("t"), tx.sentence_count(F.col("t")))).collect()]
    assert got == [0.3, 0.8, 0.7]
    df = spark.createDataFrame([("I AM LOUD",), ("this is a calm sentence here.",), ("",)], "t string")
    quality = tx.language_quality(F.col("t"), tx.measure(F.col("t")))
    got = [r[0] for r in df.select(quality).collect()]
    assert got == [pytest.approx(0.5), pytest.approx(0.8), 0.0]
