"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All of it is Column expressions.  A position is the sum of the lengths of what
stands before: the text is split at the matches, and lengths of the pieces and
of the matches are summed up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import text_or_empty

# The kinds and their patterns.
#
# Each pattern finds what its plain form (the comment above it) finds, left to
# right.  Matches are only tried where a run of characters starts, or where the
# last match ended (\G), and repetition is possessive: time stays linear in the
# text, and Java's matcher needs no stack however long a run is.
LOCAL = r"[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a character or pattern without which there is no match
    score: int  # percent, after its checks
    context: str  # words that raise the score when they stand before the span


KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind(
        "email",
        rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        70,
        "mail|contact|write to",
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"\.[0-9]",
        50,
        "ip|host|server|address",
    ),
    # [0-9]([\x20-]?[0-9])+ with 14 to 19 digits
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
        r"[0-9][\x20-]?[0-9]",
        60,
        "card|credit|visa|payment",
    ),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 50, "phone|tel|call|mobile|fax"),
    # The method's addition: account numbers, confirmed by their remainder mod 97.
    Kind("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", r"[A-Z]{2}[0-9]{2}", 80, "iban|bank|account"),
)
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS = 40
CONTEXT_SCORE = 20
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BLOCK = 256

SPAN = "array<struct<start:int,stop:int,hit:string>>"


def spans_of(text: Column, pattern: str) -> Column:
    """``array<struct<start, stop, hit>>`` of all matches, in code points, stop exclusive.

    Offsets are summed in blocks, so that a text of very many matches does not
    copy its whole list once per match.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.size(hits) == 0, F.array().cast(SPAN)).otherwise(
        _placed(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit")))
    )


def _placed(pairs: Column) -> Column:
    # The text after the last match has no match beside it.
    sized = F.transform(
        F.filter(pairs, lambda p: p["hit"].isNotNull()),
        lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("len"), p["hit"].alias("hit")),
    )

    def blocks(all_of: Column) -> Column:
        count = F.ceil(F.size(all_of) / F.lit(BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(all_of, b * BLOCK + 1, BLOCK))

    def block_starts(cut: Column) -> Column:
        return F.aggregate(
            cut,
            F.array(F.lit(0)),
            lambda at, block: F.concat(
                at, F.array(F.aggregate(block, F.element_at(at, -1), lambda n, p: n + p["gap"] + p["len"]))
            ),
        )

    def place(block: Column, start: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(start.alias("at"), F.array().cast(SPAN).alias("spans")),
            lambda done, p: F.struct(
                (done["at"] + p["gap"] + p["len"]).alias("at"),
                F.concat(
                    done["spans"],
                    F.array(
                        F.struct(
                            (done["at"] + p["gap"]).alias("start"),
                            (done["at"] + p["gap"] + p["len"]).alias("stop"),
                            p["hit"].alias("hit"),
                        )
                    ),
                ).alias("spans"),
            ),
        )["spans"]

    cut = blocks(sized)
    # transform over one value gives the blocks a name, so they are computed once.
    named = F.transform(F.array(cut), lambda c: F.struct(c.alias("cut"), block_starts(c).alias("starts")))
    return F.flatten(
        F.flatten(F.transform(named, lambda n: F.transform(n["cut"], lambda b, i: place(b, n["starts"][i]))))
    )


def luhn(digits: Column) -> Column:
    """Whether the last digit is the check digit of the others."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return (
        F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda n, i: n + worth(i)) % 10 == 0
    )


def mod_97(number: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, leaves 1."""
    moved = F.concat(F.substring(number, F.lit(5), F.length(number)), F.substring(number, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: Kind, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind.name == "ip":
        return hit.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind.name == "card":
        return luhn(digits)
    if kind.name == "phone":
        return F.length(digits).between(10, 15)
    if kind.name == "iban":
        return mod_97(hit)
    return F.lit(True)


def _found(kind: Kind, order: int) -> Column:
    text = F.col("body")
    present = F.contains(text, F.lit(kind.needs)) if len(kind.needs) == 1 else text.rlike(kind.needs)
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string,score:int>>")

    def full(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        before = F.substring(text, first + 1, s["start"] - first)
        return F.struct(
            s["start"].alias("start"),
            F.lit(order).alias("rank"),
            s["stop"].alias("stop"),
            F.lit(kind.name).alias("kind"),
            (
                F.lit(kind.score)
                + F.when(before.rlike(f"(?i)(?:^|[^a-z])(?:{kind.context})"), CONTEXT_SCORE).otherwise(0)
            ).alias("score"),
        )

    return F.when(
        present,
        F.transform(F.filter(spans_of(text, kind.pattern), lambda s: _confirmed(kind, s["hit"])), full),
    ).otherwise(none)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and ``spans``, sorted by start and kind.

    A span is ``(start, rank, stop, kind, score)``: code points, stop exclusive;
    rank is the kind's place in the list; score is in percent: the kind's own,
    raised by context words in the 40 characters before.  Null and empty texts have
    no spans; ids may repeat or be null; further columns are ignored.  There is no
    shuffle.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("body"))
    lists = [_found(kind, i) for i, kind in enumerate(KINDS)]
    return base.select("doc_id", F.array_sort(F.concat(*lists)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind and the joined spans, of the result of ``find_personal_data``."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    spans = F.col("spans")

    def count(name: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [count(kind.name) for kind in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.filter(spans, lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
