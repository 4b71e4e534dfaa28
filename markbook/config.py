"""Fixed values and tunable settings of the engine.

Every operator takes a ``Config``; nothing is read from files or from the
environment, so two runs with equal settings give equal results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from markbook.functions.lexicon import ENGLISH_STOP_WORDS, VECTORIZER_STOP_WORDS

SUBJECTS = ("reading_comprehension", "vocabulary", "writing", "language_conventions")
QUESTION_TYPES = ("multiple_choice", "short_answer", "extended_response", "cloze", "matching")
STIMULUS_TYPES = ("text", "image", "audio", "video", "none")
GRADE_LEVELS = ("Year 3",)

# Shares of a generated test by category.
SUBJECT_MIX = {
    "reading_comprehension": 0.4,
    "vocabulary": 0.3,
    "writing": 0.2,
    "language_conventions": 0.1,
}
DIFFICULTY_MIX = {"1": 0.2, "2": 0.4, "3": 0.3, "4": 0.1}
TYPE_MIX = {"multiple_choice": 0.5, "short_answer": 0.3, "extended_response": 0.2}

# The mixes that differ from the defaults, by variant number.
VARIANT_MIXES = {
    2: {
        "subject": {
            "reading_comprehension": 0.5,
            "vocabulary": 0.25,
            "writing": 0.15,
            "language_conventions": 0.1,
        }
    },
    3: {
        "subject": {
            "reading_comprehension": 0.3,
            "vocabulary": 0.25,
            "writing": 0.35,
            "language_conventions": 0.1,
        },
        "type": {"multiple_choice": 0.4, "short_answer": 0.35, "extended_response": 0.25},
    },
}


@dataclass(frozen=True)
class Config:
    """Settings of one run."""

    questions_per_test: int = 20
    subject_mix: dict = field(default_factory=lambda: dict(SUBJECT_MIX))
    difficulty_mix: dict = field(default_factory=lambda: dict(DIFFICULTY_MIX))
    type_mix: dict = field(default_factory=lambda: dict(TYPE_MIX))
    variant_mixes: dict = field(default_factory=lambda: dict(VARIANT_MIXES))

    similarity_threshold: float = 0.8
    partial_threshold: float = 0.6
    content_weight: float = 0.6
    language_weight: float = 0.3
    completeness_weight: float = 0.1
    # Short answers earn 2/1/0 whatever the rubric says, unless this is set.
    cap_to_possible: bool = False

    stop_words: tuple = ENGLISH_STOP_WORDS
    vectorizer_stop_words: tuple = VECTORIZER_STOP_WORDS
    vectorizer_features: int = 1000

    eval_fraction: float = 0.2
    seed: int = 42
    max_tokens: int = 1024
    # Handed to the caller's text generator, never used by the engine itself.
    sampling: dict = field(
        default_factory=lambda: {"temperature": 0.7, "top_p": 0.9, "max_new_tokens": 500}
    )

    # Tasks that call the text generator; None means ``spark.sql.shuffle.partitions``.
    generation_partitions: int | None = None

    # Name of the assessment programme, put into prompts and test ids.
    programme: str = ""

    def mix(self, dimension: str, variant: int = 1) -> dict:
        base = {
            "subject": self.subject_mix,
            "difficulty": self.difficulty_mix,
            "type": self.type_mix,
        }[dimension]
        return self.variant_mixes.get(variant, {}).get(dimension, base)


DEFAULT = Config()
