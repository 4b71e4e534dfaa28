"""Porter stemming (the public 1980 algorithm with the usual extensions).

Spark has no stemmer, so this is one of the two text kernels that run in Python
workers, on Arrow batches.  The rules follow the published description; stems
of short words are remembered per worker because words repeat, so many at most that
a worker stays the same size however much it reads.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Stems a worker remembers, of words of so many characters at most: some 25 MB.
REMEMBERED = 1 << 16
SHORT = 40
# Words with a set stem.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffixes of steps 2, 3 and 4, tried in this order.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """The word as a string of v(owel) and c(onsonant); y after a consonant is a vowel."""
    shape = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and shape.endswith("c"))
        shape += "v" if vowel else "c"
    return shape


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Ends consonant-vowel-consonant (last not w, x, y), or is vowel-consonant."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _swap(word: str, rules, least: int = 1) -> str:
    """Apply the first rule whose suffix fits; only if enough of the word is left."""
    for suffix, put in rules:
        if word.endswith(suffix):
            rest = word[: len(word) - len(suffix)]
            return rest + put if _measure(rest) >= least else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        rest = word[: len(word) - len(suffix)]
        if word.endswith(suffix) and "v" in _shape(rest):
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if len(rest) > 1 and rest[-1] == rest[-2] and _shape(rest)[-1] == "c":
                return rest if rest[-1] in "lsz" else rest[:-1]
            return rest + "e" if _measure(rest) == 1 and _short_end(rest) else rest
    return word


def _final_y(word: str) -> str:
    rest = word[:-1]
    if word.endswith("y") and len(rest) > 1 and _shape(rest)[-1] == "c":
        return rest + "i"
    return word


def _second(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _second(word[:-2])
    swapped = _swap(word, STEP_2)
    if swapped == word and word.endswith("logi") and _measure(word[:-3]) > 0:
        return word[:-1]
    return swapped


def _fourth(word: str) -> str:
    for suffix in STEP_4:
        if word.endswith(suffix):
            rest = word[: len(word) - len(suffix)]
            fits = _measure(rest) > 1 and (suffix != "ion" or rest[-1] in "st")
            return rest if fits else word
    return word


def _last(word: str) -> str:
    if word.endswith("e"):
        rest = word[:-1]
        size = _measure(rest)
        if size > 1 or (size == 1 and not _short_end(rest)):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem(word: str) -> str:
    """Stem of one word."""
    return _short_stem(word) if len(word) <= SHORT else _stem(word)


def _stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _final_y(_past(_plural(word)))
    return _last(_fourth(_swap(_second(word), STEP_3)))


_short_stem = lru_cache(maxsize=REMEMBERED)(_stem)


def _stemmed(text: str | None) -> str | None:
    return " ".join(map(stem, text.split(" "))) if text else text


@F.arrow_udf(StringType())
def stem_words(texts: pa.Array) -> pa.Array:
    """Stem every word of space-separated text; null stays null."""
    return pa.array([_stemmed(text.as_py()) for text in texts], pa.string())
