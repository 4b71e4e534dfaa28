"""How alike two answers are.

``normalize`` makes answers comparable (lower case, no punctuation, no stop
words, stems).  Similarity is the larger of two numbers: the TF-IDF cosine of
the pair and the matching-blocks ratio of the two strings.  Both are kernels in
Python workers on Arrow batches: Spark has no matching-blocks function, and the
cosine needs term counts within one row, for which Spark's array functions took
about four times as long (a join-and-group form would shuffle every term).
Each row is handled on its own, so nothing is shuffled and no key can be hot.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from markbook.config import DEFAULT, Config
from markbook.functions.common import drop_words
from markbook.functions.stemming import stem_words

# The vectoriser's words, and the weight of a term held by one
# text of two: ln((1 + 2) / (1 + 1)) + 1.
VECTOR_WORD = re.compile(r"\w\w+")
RARE_WEIGHT = math.log(3 / 2) + 1


def content_words(text: Column, cfg: Config = DEFAULT) -> Column:
    """Lower-case words without punctuation and stop words, joined by a space."""
    lowered = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " ")
    return F.array_join(drop_words(F.split(F.trim(lowered), " "), cfg.stop_words), " ")


def normalize(text: Column, cfg: Config = DEFAULT) -> Column:
    """``content_words`` reduced to stems."""
    return stem_words(content_words(text, cfg))


def _term_counts(text: str, stop_words: frozenset) -> Counter:
    """Words and word pairs of a text, stop words dropped before pairing."""
    words = [w for w in VECTOR_WORD.findall(text.lower()) if w not in stop_words]
    counts = Counter(words)
    counts.update(f"{a} {b}" for a, b in zip(words, words[1:]))
    return counts


def _cosine(left: str, right: str, stop_words: frozenset, features: int) -> float | None:
    """TF-IDF cosine, the two texts being the whole collection; None without terms.

    Only the ``features`` most frequent terms count, the first in the alphabet
    where frequencies tie.
    """
    a, b = _term_counts(left, stop_words), _term_counts(right, stop_words)
    terms = a.keys() | b.keys()
    if not terms:
        return None
    if len(terms) > features:
        terms = sorted(terms, key=lambda t: (-a[t] - b[t], t))[:features]
    dot = norm_a = norm_b = 0.0
    for term in terms:
        x, y = a.get(term, 0), b.get(term, 0)
        if x and y:
            dot += x * y
            norm_a += x * x
            norm_b += y * y
        else:
            norm_a += (x * RARE_WEIGHT) ** 2
            norm_b += (y * RARE_WEIGHT) ** 2
    return dot / (math.sqrt(norm_a) * math.sqrt(norm_b)) if norm_a and norm_b else 0.0


def _ratio_above(student: str, key: str, floor: float) -> float:
    """max(matching-blocks ratio, floor); cheap upper bounds often settle it."""
    pair = SequenceMatcher(None, student.lower(), key.lower())
    if pair.real_quick_ratio() <= floor or pair.quick_ratio() <= floor:
        return floor
    return max(floor, pair.ratio())


def _similarity(student: str, key: str, stop_words: frozenset, features: int) -> float:
    cosine = _cosine(student, key, stop_words, features)
    return _ratio_above(student, key, cosine or 0.0)


@lru_cache(maxsize=1 << 16)
def _short_similarity(student: str, key: str, stop_words: frozenset, features: int) -> float:
    return _similarity(student, key, stop_words, features)


def _pairwise(kernel, student: Column, key: Column) -> Column:
    """Apply a kernel to two texts row by row; null where the first is null."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series(
                [None if s is None else kernel(s, k) for s, k in zip(left, right)],
                dtype="float64",
            )

    return run(student, F.coalesce(key, F.lit("")))


def cosine(left: Column, right: Column, cfg: Config = DEFAULT) -> Column:
    """TF-IDF cosine of a pair of texts; null if neither holds a term."""
    stop, features = frozenset(cfg.vectorizer_stop_words), cfg.vectorizer_features
    value = _pairwise(lambda a, b: _cosine(a, b, stop, features), left, right)
    return F.when(~F.isnan(value), value)


def string_ratio(student: Column, key: Column) -> Column:
    """Matching-blocks ratio of two texts in lower case, the student's first."""
    return _pairwise(lambda s, k: _ratio_above(s, k, 0.0), student, key)


def similarity(student: Column, key: Column, cfg: Config = DEFAULT) -> Column:
    """max(cosine, ratio); null where the student's text is null.

    Pairs of short answers repeat; their results are kept per worker.
    """
    stop, features = frozenset(cfg.vectorizer_stop_words), cfg.vectorizer_features

    def kernel(s: str, k: str) -> float:
        short = len(s) + len(k) <= 256
        return (_short_similarity if short else _similarity)(s, k, stop, features)

    return _pairwise(kernel, student, key)
