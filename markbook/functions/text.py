"""Text features as Column expressions.

Everything here runs inside the JVM.  The costly part, splitting text into
tokens, is done once per text by ``with_metrics``; the other functions work on
the three numbers it leaves behind.

Tokens: a run of letters and digits (joined by single ``- ' . ,``) is one token,
so are the contraction endings, ``...``, ``--`` and every other visible
character.  Sentences: a terminator ``. ! ?`` before whitespace or the end of
the text closes one; text after the last terminator is one more.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions.common import (
    clamp,
    contains_any,
    drop_words,
    message_if,
    messages,
    strip,
    true_or,
)

# The token rules.
NEGATION = r"(?i)(\p{L})(n't)\b"
CLITIC = r"(?i)('(?:s|re|ve|ll|d|m))\b"
TOKEN = (
    r"\.\.\.|--|(?i:n't)\b|'(?i:s|re|ve|ll|d|m)\b"
    r"|[\p{L}\p{N}]+(?:[-'.,][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
)
SENTENCE_END = r"[.!?](?:\s|\z)"
# A vowel group that is not the first of its token and not ended by a silent e.
EXTRA_SYLLABLE = r"[aeiouy][^aeiouy ]++(?=[aiouy]|e[^ ])(?![aeiouy]+e(?: |\z))"
ANY_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
NOT_READABLE = r"[^\p{L}\p{N}_\s.,!?;:()\-]"

# Words looked for in responses and questions.
TRANSITIONS = (
    "first", "second", "then", "next", "finally", "also", "however", "because", "therefore",
)
UNSUITABLE_TOPICS = ("violence", "adult", "complex politics", "death", "scary")
SUITABLE_TOPICS = ("family", "school", "animals", "nature", "friends", "games", "food")
INDICATORS = {
    "multi_step": ("and", "also"),
    "inference_required": ("why", "how", "explain", "infer", "suggest"),
    "comparison_required": ("compare", "contrast", "similar", "different"),
    "analysis_required": ("analyze", "evaluate", "judge", "critique"),
}

# Advice on the reading level.
TOO_COMPLEX = "Text is too complex for Year 3. Use simpler words and shorter sentences."
TOO_SIMPLE = "Text might be too simple. Consider adding some complexity."
LONG_SENTENCES = "Sentences are too long. Break them into shorter sentences."
LONG_TEXT = "Text is too long. Consider shortening for Year 3 attention span."


def clean_text(text: Column) -> Column:
    """Collapse whitespace, drop characters other than words and plain punctuation."""
    collapsed = F.regexp_replace(text, ANY_SPACE, " ")
    return strip(F.regexp_replace(collapsed, NOT_READABLE, ""))


def word_tokens(text: Column) -> Column:
    """Array of word and punctuation tokens."""
    spaced = F.regexp_replace(F.regexp_replace(text, NEGATION, "$1 $2"), CLITIC, " $1")
    # Only text with an apostrophe can hold a contraction.
    prepared = F.when(F.contains(text, F.lit("'")), spaced).otherwise(text)
    return F.regexp_extract_all(prepared, F.lit(TOKEN), F.lit(0))


def sentence_count(text: Column) -> Column:
    """Number of sentences; 0 for blank text, at least 1 otherwise."""
    visible = F.rtrim(text, F.lit("\t\n\x0b\f\r "))
    last = F.substring(visible, -1, 1)
    tail = F.when((F.length(visible) > 0) & ~last.isin(".", "!", "?"), 1).otherwise(0)
    return F.regexp_count(text, F.lit(SENTENCE_END)) + tail


def count_syllables(word: Column) -> Column:
    """Vowel groups of one word, less a silent final e, at least 1."""
    lowered = F.lower(word)
    groups = F.regexp_count(lowered, F.lit("[aeiouy]+"))
    silent = F.when(lowered.endswith("e") & (groups > 1), 1).otherwise(0)
    return F.greatest(F.lit(1), groups - silent)


def total_syllables(tokens: Column) -> Column:
    """Syllables of all tokens in one scan.

    Every token counts 1; each further vowel group counts 1 more unless it is a
    silent final e.  Equal to summing ``count_syllables`` over the tokens.
    """
    return F.size(tokens) + F.regexp_count(
        F.lower(F.array_join(tokens, " ")), F.lit(EXTRA_SYLLABLE)
    )


class Metrics(NamedTuple):
    """The counts every reading measure is made of."""

    words: Column
    sentences: Column
    syllables: Column


def measure(text: Column) -> Metrics:
    """Counts of a text as expressions; null text counts 0."""
    given = F.coalesce(text, F.lit(""))
    tokens = word_tokens(given)
    return Metrics(F.size(tokens), sentence_count(given), total_syllables(tokens))


def with_metrics(df: DataFrame, text: Column, prefix: str) -> DataFrame:
    """Add the counts of a text as three plain columns.

    The token array is built in one projection and dropped in the next, so that
    it is computed once however many measures use the counts.
    """
    held = f"{prefix}__tokens"
    given = F.coalesce(text, F.lit(""))
    tokens = F.col(f"`{held}`")
    return (
        df.withColumns({held: word_tokens(given), f"{prefix}_sentences": sentence_count(given)})
        .withColumns(
            {f"{prefix}_words": F.size(tokens), f"{prefix}_syllables": total_syllables(tokens)}
        )
        .drop(held)
    )


def metrics_of(prefix: str) -> Metrics:
    """The columns left by ``with_metrics``."""
    return Metrics(
        F.col(f"{prefix}_words"), F.col(f"{prefix}_sentences"), F.col(f"{prefix}_syllables")
    )


def readability(m: Metrics) -> Column:
    """Flesch-Kincaid grade level, not below 0; 0 for empty text."""
    per_sentence = m.words / F.nullif(m.sentences, F.lit(0))
    per_word = m.syllables / F.nullif(m.words, F.lit(0))
    grade = F.lit(0.39) * per_sentence + F.lit(11.8) * per_word - F.lit(15.59)
    return F.coalesce(F.greatest(F.lit(0.0), grade), F.lit(0.0))


def average_sentence_length(m: Metrics) -> Column:
    return m.words / F.greatest(F.lit(1), m.sentences)


def is_age_appropriate(grade: Column, average: Column, words: Column) -> Column:
    return grade.between(2.0, 4.0) & (average <= 15) & (words <= 200)


def reading_advice(grade: Column, average: Column, words: Column) -> Column:
    """Advice in the order: level, sentence length, text length."""
    return messages(
        F.when(grade > 4.0, TOO_COMPLEX).when(grade < 2.0, TOO_SIMPLE),
        message_if(average > 15, LONG_SENTENCES),
        message_if(words > 200, LONG_TEXT),
    )


def age_check(grade: Column, m: Metrics) -> Column:
    """Reading level, counts, verdict and advice as one struct."""
    average = average_sentence_length(m)
    return F.struct(
        grade.alias("readability_level"),
        m.words.alias("word_count"),
        m.sentences.alias("sentence_count"),
        average.alias("avg_sentence_length"),
        is_age_appropriate(grade, average, m.words).alias("is_appropriate"),
        reading_advice(grade, average, m.words).alias("recommendations"),
    )


def organization_score(lowered: Column, sentences: Column) -> Column:
    """.3 for a single sentence, else .5 plus .3 for linking words and .2 for length."""
    linked = F.lit(0.5) + F.when(contains_any(lowered, TRANSITIONS), 0.3).otherwise(0.0)
    score = linked + F.when(sentences >= 3, 0.2).otherwise(0.0)
    return F.when(sentences < 2, 0.3).otherwise(F.least(F.lit(1.0), score))


def language_quality(text: Column, m: Metrics) -> Column:
    """Mean of three checks: sentence length, share of capitals, full stops."""
    average = m.words / F.nullif(m.sentences, F.lit(0))
    length_score = F.when(average.between(5, 15), 0.8).otherwise(0.5)
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    share = capitals / F.nullif(F.length(text), F.lit(0))
    capital_score = F.when(share < 0.3, 0.8).otherwise(0.5)
    stops = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    stop_score = F.when(stops >= m.sentences * F.lit(0.7), 0.8).otherwise(0.5)
    quality = (length_score + capital_score + stop_score) / F.lit(3.0)
    return F.when(true_or(m.words > 0), quality).otherwise(F.lit(0.0))


def question_concepts(text: Column, stop_words) -> Column:
    """Lower-case tokens of a question that are not stop words, repeats kept."""
    return drop_words(word_tokens(F.lower(F.coalesce(text, F.lit("")))), stop_words)


def concept_hits(concepts: Column, lowered_response: Column) -> Column:
    """How many concepts occur as substrings of the response."""
    return F.size(F.filter(concepts, lambda c: F.contains(lowered_response, c)))


def is_relevant(concepts: Column, lowered_response: Column) -> Column:
    """At least 30 % of the concepts, and at least one, occur in the response."""
    needed = F.greatest(F.lit(1.0), F.size(concepts) * F.lit(0.3))
    return true_or(concept_hits(concepts, lowered_response) >= needed)


def complexity_indicators(lowered: Column) -> dict[str, Column]:
    """Four flags for wording that makes a question harder."""
    return {name: contains_any(lowered, words) for name, words in INDICATORS.items()}


def topic_score(lowered: Column, appropriate: Column) -> Column:
    """1, less .3 per unsuitable topic, plus .2 for a suitable one, less .2 if hard to read."""
    score = F.lit(1.0)
    for topic in UNSUITABLE_TOPICS:
        score = score - F.when(F.contains(lowered, F.lit(topic)), 0.3).otherwise(0.0)
    score = score + F.when(contains_any(lowered, SUITABLE_TOPICS), 0.2).otherwise(0.0)
    score = score - F.when(appropriate, 0.0).otherwise(0.2)
    return clamp(score, 0.0, 1.0)


def appropriate_when_lowered(text: Column, appropriate: Column) -> Column:
    """The verdict on the lower-case text, given the verdict on the text itself.

    Lower-casing changes no count, except that a dotted capital I becomes two
    characters; only text with one is measured again.
    """
    m = measure(F.lower(text))
    again = is_age_appropriate(readability(m), average_sentence_length(m), m.words)
    return F.when(F.contains(text, F.lit("İ")), again).otherwise(appropriate)
