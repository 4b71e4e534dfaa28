from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from markbook.llm import periodic
from tests.llm.frames import ODD, frame, odd_rows, prose, result

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every run, by trying every period at every place."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        begin = q
        while begin < len(words):
            end = begin
            while end < len(words) and words[end] == words[end - q]:
                end += 1
            length = end - begin + q
            if length >= max(6, 4 * q):
                run = words[begin - q : end]
                smaller = (all(run[i] == run[i - p] for i in range(p, length)) for p in range(1, q))
                if not any(smaller):
                    out.append((begin - q, length, q))
            begin = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain_row(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    hashes = (hashlib.sha256(x.encode()).hexdigest() for x in (lines, left))
    return (doc_id, len(runs), *longest, *hashes)


def repetitive(seed):
    draw, words = random.Random(seed), []
    for _ in range(draw.randrange(1, 12)):
        unit = [draw.choice("abc"[: draw.randrange(1, 4)]) for _ in range(draw.randrange(1, 9))]
        words += unit * draw.randrange(1, 8)
        words += words[-draw.randrange(1, 30) :] * draw.randrange(0, 4)
    return " ".join(words[:300])


def test_runs_equal_trying_every_period():
    texts = [repetitive(i) for i in range(600)] + [prose(i, 200, 3) for i in range(30)]
    words = [periodic.words_of(t) for t in texts]
    assert periodic.runs_of(words) == [plain_runs(w) for w in words]
    assert sum(map(len, periodic.runs_of(words))) > 1000


@pytest.mark.parametrize(
    ("text", "runs"),
    [
        ("a a a a a", []),
        ("a a a a a a", [(0, 6, 1)]),
        ("a b a b a b a", []),
        ("x a b a b a b a b y", [(1, 8, 2)]),
        ("a b c " * 4, [(0, 12, 3)]),
        (("a " * 6 + "b ") * 4, [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]),
    ],
)
def test_small_texts(text, runs):
    assert periodic.runs_of([periodic.words_of(text)]) == [runs]


def test_very_long_texts_of_one_word_or_a_nested_period():
    one, nested = ["w"] * 200_000, (["a"] * 6 + ["b"]) * 30_000
    first, second = periodic.runs_of([periodic.words_of(" ".join(t)) for t in (one, nested)])
    assert first == [(0, 200_000, 1)]
    assert len(second) == 30_001
    assert (0, 210_000, 7) in second


def test_rows_equal_the_plain_digest(spark):
    rows = [(i, repetitive(i)) for i in range(150)] + [(200 + i, prose(i, 90)) for i in range(40)]
    rows += [(r[0], r[1]) for r in odd_rows() if r[1] is None or len(r[1]) < 1000] + rows[:5]
    got = result(periodic.digest(periodic.find_runs(periodic.with_planted_runs(frame(spark, rows)))))
    assert got == sorted((plain_row(*r) for r in rows), key=repr)


def test_collapsed_texts_and_odd_rows(spark):
    rows = [(1, "x " + "go on " * 9 + "y"), (None, "a a a a a a a"), (3, "  \u0085b"), *odd_rows()]
    found = periodic.find_runs(frame(spark, rows)).collect()
    left = {(r["doc_id"], r["text"]): r["collapsed"] for r in found}
    assert len(found) == len(rows)
    assert left[1, rows[0][1]] == "x go on y"
    assert left[None, rows[1][1]] == "a"
    assert left[3, rows[2][1]] == "  \u0085b"
    assert {r["collapsed"] for r in found if r["text"] in (None, "", " \n\t ")} == {""}
    assert {r["collapsed"] for r in found if r["text"] == ODD[6]} == {"word"}


def test_empty_table(spark):
    empty = frame(spark, [(1, "a")]).where("false")
    assert periodic.digest(periodic.find_runs(periodic.with_planted_runs(empty))).count() == 0


def test_given_table(spark):
    from markbook.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in docs if len(r["text"] or "") < 4000}
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, folder).collect()]
    assert len(got) == len(docs)
    assert sorted(r for r in got if r[0] in short) == sorted(plain_row(*d) for d in short.items())
