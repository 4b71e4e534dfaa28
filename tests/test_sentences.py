from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from markbook.operators import sentences as st

NAMES = ["Smith", "Jones", "Brown", "Miller"]
FILLER = "walked home today with some bread and then slept until noon near our river".split()


def labelled(seed, texts):
    """Texts with abbreviations, titles and numbers, and how many sentences each really has."""
    draw, out = random.Random(seed), []
    for i in range(texts):
        made = []
        for _ in range(draw.randrange(1, 9)):
            start, filler, kind = draw.choice(["The", "He", "It"]), " ".join(draw.sample(FILLER, 6)), draw.random()
            if kind < 0.3:
                made.append(f"{start} met Dr. {draw.choice(NAMES)} and {filler}.")
            elif kind < 0.5:
                made.append(f"{start} {filler}, e.g. bread and milk.")
            elif kind < 0.6:
                made.append(f'"{start} paid No. 5 and {filler}!"')
            elif kind < 0.7:
                made.append(f"{start} saw J. {draw.choice(NAMES)} (again) ...")
            else:
                made.append(f"{start} {filler}.")
        out.append((i, " ".join(made), len(made)))
    return out


def words_of(text):
    for piece in re.split(r"[\x09-\x0D\x20]+", text or ""):
        if piece:
            yield piece


def word_of(piece):
    return re.sub(r"[\"')\]}’”»]+\Z", "", re.sub(r"^[\"'(\[{‘“«]+", "", piece))


def type_of(word):
    plain = re.sub(r"[.!?,;:]+\Z", "", word.lower())
    return "##number##" if re.match(r"[-+]?[.,]?[0-9][0-9.,]*\Z", plain) else plain


def plain_abbreviations(texts):
    with_period, without = Counter(), Counter()
    for text in texts:
        for piece in words_of(text):
            word = word_of(piece)
            marks = re.search(r"[.!?]*\Z", word).group()
            (with_period if marks == "." else without)[type_of(word)] += 1
    periods, total = sum(with_period.values()), sum(with_period.values()) + sum(without.values())
    out = {}
    for kind, a in with_period.items():
        if not any(c.isalpha() for c in kind):
            continue
        rest, dots = without[kind], kind.count(".")
        letters = len(kind) - dots
        p = periods / total
        chance = a * math.log(p) + rest * math.log(1 - p)
        surprise = -2 * (chance - a * math.log(0.99) - rest * math.log(1 - 0.99))
        score = surprise * math.exp(-letters) * (dots + 1) * max(letters, 1.0) ** -rest
        if score >= 0.3:
            out[kind] = (a, rest, round(score, 6))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")


def test_abbreviations_equal_plain_counts(spark):
    rows = labelled(1, 250)
    short, opened = st.learnt(frame(spark, rows))
    got = {r["type"]: (r["with_period"], r["without_period"], round(r["score"], 6)) for r in short.collect()}
    assert got == plain_abbreviations([r[1] for r in rows])
    assert {"dr", "e.g", "no"} <= set(got)
    pairs = {(r["word"], r["next"]) for r in opened.collect()}
    assert {("Dr.", "Smith"), ("e.g.", "bread"), ("No.", "5"), ("J.", "Brown")} <= pairs
    assert not any(a in ("milk.", "river.") for a, _ in pairs)


def test_sentences_are_counted_right(spark):
    rows = labelled(2, 300)
    got = {r["doc_id"]: r["n_sentences"] for r in st.sentence_counts(frame(spark, rows)).collect()}
    right = sum(got[i] == n for i, _, n in rows)
    assert right >= 0.99 * len(rows)
    naive = sum(len(re.findall(r"[.!?]+(?=\s|\Z|\")", text)) == n for _, text, n in rows)
    assert naive < 0.6 * len(rows)


def test_odd_texts(spark):
    odd = [None, "", " \t\n", "no end", "One. two", "end.", "?!", "...", "3. Then 4. now", "é. É", '("Yes.")', "a" * 20_000, "x. " * 5000]
    rows = [*enumerate(odd), (None, "A b. C d")]
    got = {r["doc_id"]: (r["n_sentences"], r["n_open"]) for r in st.sentence_counts(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert [got[i][0] for i in (0, 1, 2, 3, 5, 6, 7, 10, 11)] == [0, 0, 0, 1, 1, 1, 1, 1, 1]
    assert got[None] == (2, 0)
    assert got[8] == (2, 1)  # "3. Then" ends, "4. now" goes on
    assert st.sentence_counts(frame(spark, [(1, "x")]).where("false")).count() == 0


@pytest.mark.parametrize("n12, n1, n2, n", [(5, 10, 20, 1000), (0, 10, 20, 1000), (10, 10, 10, 1000), (1, 1, 1, 1)])
def test_likelihood_ratio(spark, n12, n1, n2, n):
    def of(k, m, p):
        return k * math.log(max(p, 1e-12)) + (m - k) * math.log(max(1 - p, 1e-12))

    alone, without = n2 - n12, max(n - n1, 1)
    expected = -2 * (of(n12, n1, n2 / n) + of(alone, without, n2 / n) - of(n12, n1, n12 / n1) - of(alone, without, alone / without))
    row = spark.createDataFrame([tuple(map(float, (n12, n1, n2, n)))], "a double, b double, c double, d double")
    columns = [row[c] for c in "abcd"]
    assert row.select(st._likelihood(*columns)).head()[0] == pytest.approx(expected)
