"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of sample words.  A text is parsed, word by
word, into the longest phrases that occur in the sample; a language that knows the
text needs few.  Phrase counts are normalised by the size of the sample, as in the
cross-parsing estimate of cross entropy: phrases x log2(sample) / characters.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markbook.llm.automaton import SuffixAutomaton
from markbook.llm.common import held

UNKNOWN = "und"
#: Bounds of the sample: documents looked at and words kept, per language.
SAMPLE_DOCUMENTS = 500
SAMPLE_WORDS = 10_000
SAMPLE_WORD_CHARS = 40
_KEPT = 200_000  # words whose phrase counts a worker remembers
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def sample_words(
    docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, words: int = SAMPLE_WORDS
) -> dict[str, list[str]]:
    """Per language its most frequent words in about ``documents`` documents, chosen by hash."""
    known = docs.select("doc_id", "lang", "text").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = known.join(F.broadcast(counts), "lang").where(place < documents / F.col("n"))
    found = (
        chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        .where(F.length("word") <= SAMPLE_WORD_CHARS)
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    out: dict[str, list[str]] = {}
    for row in found.withColumn("rank", rank).where(F.col("rank") <= words).orderBy("lang", "rank").collect():
        out.setdefault(row["lang"], []).append(row["word"])
    return out


class Parser:
    """Phrase counts of texts in each language."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        self.automata: list[SuffixAutomaton] = []
        self.weights: list[float] = []
        for language in self.languages:
            automaton = SuffixAutomaton()
            for word in samples[language]:
                automaton.add(f" {word} ")
            self.automata.append(automaton)
            self.weights.append(math.log2(2 + sum(len(w) + 1 for w in samples[language])))
        self.known: dict[str, int] = {}

    def phrases(self, word: str) -> list[int]:
        """Per language: the fewest phrases, longest first, that the word takes."""
        out = []
        for automaton in self.automata:
            follow = automaton.follow
            count = state = 0
            for symbol in f" {word} ":
                to = follow[state].get(symbol) if state else None
                if to is None:  # a new phrase; a symbol that the sample lacks is one by itself
                    count += 1
                    to = follow[0].get(symbol, 0)
                state = to
            out.append(count)
        return out

    def _count(self, word: str) -> int:
        if len(self.known) > _KEPT:
            self.known.clear()
        packed = 0
        for count in reversed(self.phrases(word)):
            packed = packed << 48 | count
        self.known[word] = packed
        return packed

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the fewest normalised phrases, and how far ahead it is (0 to 1)."""
        words = _WORD.findall(text.lower()) if text else []
        if not self.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        known, count = self.known, self._count
        # Counts of all languages add up in one number, 48 bits each.
        packed = 0
        for w in words:
            packed += known.get(w) or count(w)
        costs = []
        for weight, language in zip(self.weights, self.languages, strict=True):
            costs.append(((packed & (1 << 48) - 1) * weight, language))
            packed >>= 48
        costs.sort()
        best = costs[0][0]
        second = costs[1][0] if len(costs) > 1 else 2 * best
        return costs[0][1], (second - best) / second


def prediction(spark: SparkSession, samples: dict[str, list[str]]) -> Callable[[Column | str], Column]:
    """A function of a text column: ``struct<lang_pred, score>``.

    ``und`` with score 0 where the text is null or has no letter, or where there is no
    sample.  Of equal costs the first language by name wins, with score 0.  Whole
    texts are read.  The samples are bounded (``SAMPLE_WORDS`` a language) and broadcast.
    """
    sent = spark.sparkContext.broadcast(samples)
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        parser = held(("language", key), lambda: Parser(sent.value))
        return pd.DataFrame([parser.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def predict_languages(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    Learns from the rows that are not held out and have a language; a null id is not
    held out and not learnt from.  Repeated rows get equal answers; extra columns are
    ignored; an empty table gives no rows.  Nothing but the samples is shuffled.
    """
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    predict = prediction(docs.sparkSession, sample_words(docs.where(~out)))
    found = docs.select("doc_id", predict("text").alias("found"))
    return found.select("doc_id", out.alias("held_out"), "found.lang_pred", "found.score")
