"""Documents for the tests of this folder."""

from __future__ import annotations

import random

# Names that operators use themselves, as columns a user's table may have too.
CLASHING = (
    "kept boolean, text_sha256 string, spans string, row long, body string, key long, part int, slot int, "
    "component_id long, length int, prefix long, words string, starts int, items string, seed long, id long, n long, "
    "score double, label string, class string, page string, a long, b long, hit string, rank int"
)


def frame(spark, rows, extra=True):
    """Rows of ``(doc_id, text)`` or ``(doc_id, text, lang)`` as a documents table with clashing columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    names = CLASHING.count(",") + 1 if extra else 0
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0, *[None] * names) for r in rows]
    return spark.createDataFrame(full, schema + (", " + CLASHING if extra else "")).repartition(3)


def prose(seed, count, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(count))


def edited(text, seed, edits):
    draw = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
    return " ".join(words)


ODD = [None, "", " \n\t ", "a", "é", "a" * 30_000, "word " * 5_000, "\u0000\u0001", "😀 😀", "<|endoftext|> x", "x y z"]


def odd_rows(start=10_000):
    """Odd texts, each twice: ids of their own, then a repeated row; and rows without an id."""
    rows = [(start + i, t) for i, t in enumerate(ODD * 2)]
    return [*rows, (start, ODD[0]), (None, "no id at all"), (None, None)]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
