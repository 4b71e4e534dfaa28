"""Where sentences end, learnt from the texts themselves.

A period after an abbreviation, an initial or a number need not end a sentence.  Which words
are abbreviations is learnt without labels, as Kiss and Strunk describe it: a word is one
if it comes with a period far more often than by chance, the more so if it is short and has
periods inside; pairs such as "No. 5" or "Dr. Who" are found as collocations across a period;
and words that start sentences often show that a period before them does end one.  All
counts are Spark aggregates, so the learnt tables grow with the vocabulary, not with the
texts, and every text counts.

Words are split and counted per Arrow batch before Spark adds the counts up: a row per
word in the JVM took some five times as long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.plans.joins import lookup_join, small
from markbook.plans.stage import stage

# The published thresholds.
ABBREVIATION_SCORE = 0.3
COLLOCATION_SCORE = 7.88
STARTER_SCORE = 30.0
#: The chance that an abbreviation comes with a period.
WITH_PERIOD = 0.99

_TRAILING = r"[\"')\]}’”»]+\z"
_LEADING = r"^[\"'(\[{‘“«]+"
_MARKED = re.compile(r"[.!?][\"')\]}’”»]*\Z")
_LEADING_QUOTES, _TRAILING_QUOTES = re.compile(r"\A[\"'(\[{‘“«]+"), re.compile(r"[\"')\]}’”»]+\Z")
NUMBER = "##number##"
#: Words that a task counts before it hands its counts on, and kinds of words that it remembers.
AT_ONCE = 1 << 20
_KEPT = 1 << 18


class _Marks(dict):
    """Per piece, as bytes: None without a mark at its end, else the word and whether it ends with one period."""

    def __missing__(self, piece: bytes) -> tuple[str, bool] | None:
        if len(self) >= _KEPT:
            self.clear()
        text = piece.decode("utf-8", "surrogatepass")
        found = None
        if _MARKED.search(text):
            word = _TRAILING_QUOTES.sub("", _LEADING_QUOTES.sub("", text))
            found = word, word.endswith(".") and not word[:-1].endswith((".", "!", "?"))
        self[piece] = found
        return found


def _split(text: str | None) -> list[bytes]:
    """What ASCII white space parts; a null text has nothing."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``piece, next, n``: every piece and, behind a mark, the next one, counted per task."""
    marks, counts, held = _Marks(), Counter(), 0

    def rows() -> pa.RecordBatch:
        pieces, following = zip(*counts, strict=True)
        text = [pa.array([None if x is None else x.decode("utf-8", "surrogatepass") for x in xs], pa.string()) for xs in (pieces, following)]
        return pa.RecordBatch.from_arrays([*text, pa.array(list(counts.values()), pa.int64())], names=["piece", "next", "n"])

    for batch in batches:
        for text in batch["text"]:
            pieces = _split(text.as_py())
            counts.update((a, b if marks[a] else None) for a, b in zip(pieces, [*pieces[1:], None], strict=False))
            held += len(pieces)
            if held >= AT_ONCE:
                yield rows()
                counts, held = Counter(), 0
    if counts:
        yield rows()


_PAIRS = pa.list_(pa.struct([("word", pa.string()), ("next", pa.string())]))


def _mark_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text how many marks it has, whether words follow the last one, and the pairs about one period."""
    marks = _Marks()
    for batch in batches:
        number, tails, pairs = [], [], []
        for text in batch["text"]:
            pieces = _split(text.as_py())
            at = [i for i, piece in enumerate(pieces) if marks[piece]]
            number.append(len(at))
            tails.append(int(bool(pieces) and (not at or at[-1] + 1 < len(pieces))))
            listed = []
            for i in at:
                word, one_period = marks[pieces[i]]
                if one_period and i + 1 < len(pieces):
                    following = pieces[i + 1].decode("utf-8", "surrogatepass")
                    listed.append({"word": word, "next": _TRAILING_QUOTES.sub("", _LEADING_QUOTES.sub("", following))})
            pairs.append(listed)
        arrays = [batch["key"], pa.array(number, pa.int64()), pa.array(tails, pa.int64()), pa.array(pairs, _PAIRS)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "marks", "tail", "pairs"])


def _word(piece: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(piece, _LEADING, ""), _TRAILING, "")


def _ends(word: Column) -> Column:
    """How a word ends: ``.`` for one period, ``!`` for any other marks that end a sentence, or null."""
    marks = F.length(word) - F.length(F.regexp_replace(word, r"[.!?]+\z", ""))
    return F.when((marks == 1) & word.endswith("."), ".").when(marks > 0, "!")


def _type(word: Column) -> Column:
    """What words are counted as: lower case, without the marks at the end; numbers count as one."""
    plain = F.regexp_replace(F.lower(word), r"[.!?,;:]+\z", "")
    return F.when(plain.rlike(r"^[-+]?[.,]?[0-9][0-9.,]*\z"), NUMBER).otherwise(plain)


def pair_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word, ends, type, next, next_type, n``: every word and, behind a mark, the next one, with their number.

    All that is learnt is learnt from this table: the texts are read once, and patterns
    look at each pair once, however often it occurs.
    """
    counted = texts.select(F.col(text).alias("text")).mapInArrow(_count_pairs, "piece string, next string, n long")
    rows = counted.groupBy("piece", "next").agg(F.sum("n").alias("n"))
    word, following = _word(F.col("piece")), _word(F.col("next"))
    named = rows.select(word.alias("word"), following.alias("next"), "n")
    return stage(
        named.select("word", _ends(F.col("word")).alias("ends"), _type(F.col("word")).alias("type"), "next",
                     _type(F.col("next")).alias("next_type"), "n")
        .groupBy("word", "ends", "type", "next", "next_type")
        .agg(F.sum("n").alias("n"))
    )


def _surprise(both: Column, first: Column, chance: Column, other: Column) -> Column:
    """Twice the log-likelihood that ``both`` of ``first`` comes at rate ``other`` rather than by ``chance``."""
    eps = F.lit(1e-12)
    rest = first - both

    def of(p: Column) -> Column:
        return both * F.ln(F.greatest(p, eps)) + rest * F.ln(F.greatest(1 - p, eps))

    return -2 * (of(chance) - of(other))


def _likelihood(n12: Column, n1: Column, n2: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of two words that come together."""
    eps = F.lit(1e-12)

    def of(k: Column, m: Column, p: Column) -> Column:
        return k * F.ln(F.greatest(p, eps)) + (m - k) * F.ln(F.greatest(1 - p, eps))

    alone = n2 - n12
    without = F.greatest(n - n1, F.lit(1.0))
    p, p1, p2 = n2 / n, n12 / n1, alone / without
    return -2 * (of(n12, n1, p) + of(alone, without, p) - of(n12, n1, p1) - of(alone, without, p2))


def type_counts(pairs: DataFrame) -> DataFrame:
    """``type, with_period, without_period``: how often a word comes with one period behind it, and without."""
    period = F.coalesce(F.col("ends") == ".", F.lit(False))
    return pairs.groupBy("type").agg(
        F.sum(F.when(period, F.col("n")).otherwise(0)).alias("with_period"),
        F.sum(F.when(period, 0).otherwise(F.col("n"))).alias("without_period"),
    )


def abbreviations(counts: DataFrame, least: float = ABBREVIATION_SCORE) -> DataFrame:
    """``type, with_period, without_period, score``: the abbreviations among ``type_counts``.

    Words without a letter are none.
    """
    totals = counts.agg(
        F.sum("with_period").alias("_periods"), F.sum(F.col("with_period") + F.col("without_period")).alias("_words")
    )
    periods = F.length("type") - F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    letters = F.length("type") - periods
    a, rest = F.col("with_period").cast("double"), F.col("without_period").cast("double")
    surprise = _surprise(a, a + rest, F.col("_periods") / F.col("_words"), F.lit(WITH_PERIOD))
    penalty = F.pow(F.greatest(letters, F.lit(1)).cast("double"), -rest)
    score = surprise * F.exp(-letters.cast("double")) * (periods + 1) * penalty
    return (
        counts.where((F.col("with_period") > 0) & F.col("type").rlike(r"\p{L}"))
        .join(F.broadcast(totals))  # one row
        .select("type", "with_period", "without_period", score.alias("score"))
        .where(F.col("score") >= least)
    )


def with_short(pairs: DataFrame, short: DataFrame) -> DataFrame:
    """The pairs behind a mark, and whether it is one period behind an abbreviation or an initial."""
    known = short.select("type", F.lit(True).alias("_short"))
    initial = F.col("word").rlike(r"^\p{Lu}\.\z")
    is_short = (F.col("ends") == ".") & (F.coalesce("_short", F.lit(False)) | initial)
    return lookup_join(pairs.where("ends is not null"), known, ["type"], "left").withColumn("is_short", is_short).drop("_short")


def starters(marked: DataFrame, counts: DataFrame, least: float = STARTER_SCORE) -> DataFrame:
    """``type, n, starts, score``: the words that start sentences more often than by chance.

    Counted behind marks that surely end a sentence: not behind an abbreviation or an initial.
    """
    sure = marked.where(~F.col("is_short") & F.col("next_type").rlike(r"^\p{L}"))
    begun = sure.groupBy(F.col("next_type").alias("type")).agg(F.sum("n").alias("starts"))
    totals = counts.agg(F.sum(F.col("with_period") + F.col("without_period")).cast("double").alias("_words"))
    ends = sure.agg(F.sum("n").cast("double").alias("_ends"))
    n = F.col("with_period") + F.col("without_period")
    share = F.col("starts").cast("double") / F.col("_ends")
    score = _likelihood(F.col("starts").cast("double"), F.col("_ends"), F.col("n").cast("double"), F.col("_words"))
    return (
        begun.join(counts.select("type", n.alias("n")), "type")
        .join(F.broadcast(totals))  # one row
        .join(F.broadcast(ends))  # one row
        .withColumn("score", score)
        .where((F.col("score") >= least) & (share > F.col("n") / F.col("_words")))
        .select("type", "n", "starts", "score")
    )


def collocations(
    marked: DataFrame, counts: DataFrame, begin: DataFrame, least: float = COLLOCATION_SCORE
) -> DataFrame:
    """``type, next_type, n, score``: pairs across a period that belong together, such as a title and a name.

    The first is an abbreviation, an initial or a number, the second no word that starts
    sentences; a pair is seen twice at least.
    """
    across = F.col("is_short") | ((F.col("type") == NUMBER) & (F.col("ends") == "."))
    both = (
        marked.where(across & F.col("next_type").rlike(r"[\p{L}#]"))
        .groupBy("type", "next_type")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .join(begin.select(F.col("type").alias("next_type")), "next_type", "left_anti")
    )
    of = (F.col("with_period") + F.col("without_period")).cast("double")
    totals = counts.agg(F.sum(of).alias("_words"))
    score = _likelihood(F.col("n").cast("double"), F.col("_first"), F.col("_second"), F.col("_words"))
    return (
        both.join(counts.select("type", of.alias("_first")), "type")
        .join(counts.select(F.col("type").alias("next_type"), of.alias("_second")), "next_type")
        .join(F.broadcast(totals))  # one row
        .withColumn("score", score)
        .where((F.col("score") >= least) & (F.col("n") / F.col("_first") > F.col("_second") / F.col("_words")))
        .select("type", "next_type", "n", "score")
    )


def open_pairs(marked: DataFrame, begin: DataFrame, together: DataFrame) -> DataFrame:
    """``word, next``: the pairs between which a mark does not end a sentence.

    One period behind an abbreviation or an initial ends a sentence only if the next word
    starts with a capital letter and often starts sentences, and the two do not belong
    together; one behind a number if the next word starts with a capital letter and does not
    belong to it.  Every other mark ends a sentence, and so does any at the end of a text.
    """
    begins = begin.select(F.col("type").alias("next_type"), F.lit(True).alias("_begins"))
    pairs = together.select("type", "next_type", F.lit(True).alias("_together"))
    doubtful = marked.where(
        F.col("next").isNotNull() & (F.col("ends") == ".") & (F.col("is_short") | (F.col("type") == NUMBER))
    )
    told = lookup_join(lookup_join(doubtful, begins, ["next_type"], "left"), pairs, ["type", "next_type"], "left")
    ends = F.col("next").rlike(r"^\p{Lu}") & F.col("_together").isNull() & (~F.col("is_short") | F.col("_begins").isNotNull())
    return told.where(~ends).select("word", "next").distinct()


def learnt(texts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The abbreviations of the texts, and the pairs of ``open_pairs``."""
    pairs = pair_counts(texts, text)
    counts = stage(type_counts(pairs))
    short = stage(abbreviations(counts))
    marked = with_short(pairs, short)
    begin = stage(starters(marked, counts))
    together = stage(collocations(marked, counts, begin))
    return short, open_pairs(marked, begin, together)


def sentence_counts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_sentences, n_open`` of every row, by tables learnt from all rows.

    ``n_open`` counts the periods that end no sentence.  Text behind the last end is a
    sentence; a blank or null text has none.  The keys of texts are distinct; a null key has
    a row too.
    """
    _, opened = learnt(texts, text)
    kind = texts.schema[key].dataType.simpleString()
    schema = f"key {kind}, marks long, tail long, pairs array<struct<word: string, next: string>>"
    marked = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_mark_texts, schema)
    sized = marked.select(F.col("key").alias("_key"), "marks", "tail")
    doubtful = marked.select(F.col("key").alias("_key"), F.inline("pairs"))
    found = doubtful.join(small(opened), ["word", "next"], "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_open"))
    joined = sized.join(found.withColumnRenamed("_key", "_of"), F.col("_key").eqNullSafe(F.col("_of")), "left")
    kept = F.coalesce("_open", F.lit(0)).cast("long")
    return joined.select(
        F.col("_key").alias(key), (F.col("marks") - kept + F.col("tail")).alias("n_sentences"), kept.alias("n_open")
    )
