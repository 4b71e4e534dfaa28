import zlib

import pytest

from markbook.llm import language
from markbook.llm.automaton import SuffixAutomaton
from tests.llm.frames import ODD, frame, odd_rows

SAMPLES = {"en": ["the", "of", "and", "there", "other"], "de": ["der", "die", "und", "nicht", "oder"]}


def fewest(word, known):
    """Longest-first phrases by trying every prefix."""
    text, count = f" {word} ", 0
    while text:
        n = max((k for k in range(1, len(text) + 1) if any(text[:k] in f" {w} " for w in known)), default=1)
        text, count = text[n:], count + 1
    return count


@pytest.mark.parametrize("word", ["the", "under", "thendie", "xyz", "nichtthe", "a", "é"])
def test_phrases_match_brute_force(word):
    parser = language.Parser(SAMPLES)
    assert parser.phrases(word) == [fewest(word, SAMPLES[x]) for x in parser.languages]


def test_prediction():
    parser = language.Parser(SAMPLES)
    assert parser.predict("The other and the")[0] == "en"
    assert parser.predict("Und nicht oder, die!")[0] == "de"
    assert parser.predict(None) == parser.predict("12 %% ²") == (language.UNKNOWN, 0.0)
    assert all(0 <= parser.predict(t)[1] <= 1 for t in ODD)
    assert language.Parser({}).predict("word") == (language.UNKNOWN, 0.0)


def test_automaton_knows_all_substrings():
    automaton = SuffixAutomaton()
    words = ["abcbc", "bcab", "aaa", "", "cabcb"]
    for i, w in enumerate(words):
        automaton.add(w, i)
    inside = {w[a:b] for w in words for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
    sets = automaton.numbers_below(1)
    for s in inside:
        state, matched = 0, 0
        for c in s:
            state, matched = automaton.step(state, matched, c)
        assert matched == len(s)
        assert sets[state] == {i for i, w in enumerate(words) if s in w}


def test_held_out_rows_teach_nothing(spark):
    english = "the other there and of the"
    rows = [(i, english, "en") for i in range(30)]
    german = [i for i in range(100, 160) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows += [(i, "nicht oder und die der", "de") for i in german]
    rows += odd_rows()
    got = language.predict_languages(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["lang_pred"] in ("en", "und")  # German was only in held-out rows


def test_empty_table(spark):
    assert language.predict_languages(frame(spark, [])).count() == 0
    nothing_known = frame(spark, [(1, "some text", None)])
    assert [tuple(r) for r in language.predict_languages(nothing_known).select("lang_pred", "score").collect()] == [
        ("und", 0.0)
    ]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.99 * got.count()
