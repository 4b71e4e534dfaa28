from __future__ import annotations

import math
import random
import re
import tracemalloc
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from markbook.config import DEFAULT, Config
from markbook.functions import similarity as sim
from markbook.functions.lexicon import ENGLISH_STOP_WORDS, VECTORIZER_STOP_WORDS
from markbook.functions.stemming import REMEMBERED, stem

# Stems published with the algorithm and its usual extensions.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "dies": "die", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "dying": "die", "enjoy": "enjoy", "by": "by", "say": "say",
    "relational": "relat", "conditional": "condit", "digitizer": "digit", "operator": "oper",
    "feudalism": "feudal", "hopefulness": "hope", "formaliti": "formal", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formalize": "formal", "electrical": "electr", "goodness": "good",
    "revival": "reviv", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt",
    "communism": "commun", "effective": "effect", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "breakable": "breakabl",
    "spied": "spi", "died": "die", "geology": "geolog",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_word_lists():
    assert len(ENGLISH_STOP_WORDS) == len(set(ENGLISH_STOP_WORDS)) == 179
    assert len(VECTORIZER_STOP_WORDS) == 318


def cosine_twin(a, b, features=1000):
    stop = set(VECTORIZER_STOP_WORDS)

    def counts(t):
        w = [x for x in re.findall(r"\b\w\w+\b", t.lower()) if x not in stop]
        return Counter(w + [" ".join(p) for p in zip(w, w[1:])])

    x, y = counts(a), counts(b)
    terms = sorted(set(x) | set(y), key=lambda t: (-(x[t] + y[t]), t))[:features]
    if not terms:
        return None
    idf = {t: math.log(3 / (1 + (x[t] > 0) + (y[t] > 0))) + 1 for t in terms}
    u, v = [x[t] * idf[t] for t in terms], [y[t] * idf[t] for t in terms]
    nu, nv = math.sqrt(sum(i * i for i in u)), math.sqrt(sum(i * i for i in v))
    return sum(i * j for i, j in zip(u, v)) / (nu * nv) if nu and nv else 0.0


def pairs():
    rng = random.Random(7)
    words = "red blue fish dog the a cat kind of breakable easily broken thing also house".split()
    made = [
        (" ".join(rng.choices(words, k=rng.randint(0, 25))), " ".join(rng.choices(words, k=rng.randint(0, 12))))
        for _ in range(150)
    ]
    long = " ".join(rng.choices(words, k=400))
    return made + [("kind of blue", "blue"), ("", ""), ("the", "of"), (long, long[:300]), ("Ünïcode Wörd", "wörd")]


def test_pair_measures_equal_brute_force(spark):
    data = pairs()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    small = Config(vectorizer_features=5)
    rows = (
        df.select("i", sim.cosine(a, b), sim.string_ratio(a, b), sim.similarity(a, b), sim.cosine(a, b, small))
        .orderBy("i")
        .collect()
    )
    for row, (x, y) in zip(rows, data):
        ratio = SequenceMatcher(None, x.lower(), y.lower()).ratio()
        cosine = cosine_twin(x, y)
        assert row[1] == (None if cosine is None else pytest.approx(cosine))
        assert row[2] == pytest.approx(ratio)
        assert row[3] == pytest.approx(max(cosine or 0.0, ratio))
        limited = cosine_twin(x, y, 5)
        assert row[4] == (None if limited is None else pytest.approx(limited))


def test_normalize(spark):
    df = spark.createDataFrame([("The easily-broken vases, (breaking)!",), ("of the",), (None,)], "t string")
    rows = df.select(sim.normalize(F.col("t")), sim.content_words(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [
        ("easili broken vase break", "easily broken vases breaking"),
        ("", ""),
        ("", ""),
    ]
    assert DEFAULT.similarity_threshold == 0.8


def test_remembered_stems_stay_small():
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for i in range(200_000):
            stem(f"wordlike{i}")
        for i in range(2_000):
            stem(f"{i}" + "x" * 20_000)
        held = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert held < 600 * REMEMBERED
