"""Small Column helpers shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace of any kind (``trim`` drops spaces only)."""
    return F.trim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """Null or empty; text of spaces is not blank."""
    return F.coalesce(F.length(text) == 0, F.lit(True))


def has_items(array: Column) -> Column:
    """The array is present and holds at least one element."""
    return F.coalesce(F.size(array) > 0, F.lit(False))


def drop_words(words: Column, unwanted) -> Column:
    """The array without blanks and the unwanted words.

    The list is written into one SQL lambda: as a set of literals it is looked up
    by hash, and building it takes one call rather than one per word.
    """
    listed = ", ".join("'" + w.replace("'", "\\'") + "'" for w in unwanted)
    keep = f"w -> w <> '' and w not in ({listed})" if listed else "w -> w <> ''"
    return F.call_function("filter", words, F.expr(keep))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def true_or(condition: Column, default: bool = False) -> Column:
    """A condition with null read as ``default``."""
    return F.coalesce(condition, F.lit(default))


def messages(*candidates: Column) -> Column:
    """Array of the candidates that are not null, in the order given."""
    return F.filter(F.array(*candidates), lambda m: m.isNotNull())


def message_if(condition: Column, text: str | Column) -> Column:
    """The message where the condition holds, null elsewhere."""
    return F.when(condition, F.lit(text) if isinstance(text, str) else text)


def contains_any(text: Column, words) -> Column:
    """Whether any of the words occurs as a substring (stays in generated code)."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it.

    Keeps a costly value from being copied into every place it is used when the
    optimizer merges projections or pushes filters down.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def choose(key: Column, values: dict, default) -> Column:
    """Dictionary lookup with a default, as a plain CASE expression."""
    if not values:
        return F.lit(default)
    expr = None
    for k, v in values.items():
        branch = key == F.lit(k)
        expr = F.when(branch, F.lit(v)) if expr is None else expr.when(branch, F.lit(v))
    return expr.otherwise(F.lit(default))
