"""Periodic runs of words by an online sparse diagonal walk.

A word that equals the word q places before it lies on the diagonal of lag q; a run of
period q is a stretch of that diagonal.  Only lags that can end as runs are walked: a run
of at least four periods matches at least 3q words on its diagonal, so for the lags of
an octave, 2^k to 2^(k+1) - 1, a place counts only if the 3 * 2^k words from it on occur
earlier at such a lag, and of those occurrences only the nearest can belong to a run of
that smallest period (two occurrences that near, or a nearer one, give the words a
period below 2^k, which then is the run's: Fine and Wilf).  So each place extends at
most one diagonal per octave, and a diagonal that breaks emits its run at once.  Equal
stretches of 2^k words get equal numbers by doubling, without hashes: results are exact,
at n log^2 n for a text of n words, whatever it repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import WHITE_SPACE, text_or_empty

#: A run has this many words at least, and this many periods.
MIN_WORDS = 6
MIN_PERIODS = 4
#: Words of several texts that are worked on at once.
AT_ONCE = 1 << 17

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; ASCII white space, as ``bytes.split`` knows it, parts them."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _numbers(texts: list[list[bytes]]) -> np.ndarray:
    """All texts in a row as numbers, equal words of one text alike, a number of its own behind each."""
    codes = np.empty(sum(map(len, texts)) + len(texts), np.int64)
    at = first = 0
    for words in texts:
        known = {w: first + i for i, w in enumerate(set(words))}
        codes[at : at + len(words)] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        first += len(known) + 1
        codes[at + len(words)] = first - 1
        at += len(words) + 1
    return codes


def _named(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for pairs of numbers, and how often each pair is there."""
    _, name, count = np.unique(left << 32 | right, return_inverse=True, return_counts=True)
    return name, count[name]


def _nearest(places: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For every place how far back its name was last; 0 where it is new."""
    order = np.argsort(names, kind="stable")  # places rise, so they do within a name
    again = np.diff(names[order]) == 0
    lag = np.zeros(len(places), np.int64)
    lag[order[1:][again]] = np.diff(places[order])[again]
    return lag


def _walk(places: np.ndarray, lags: np.ndarray, grams: int) -> Iterator[tuple[int, int, int]]:
    """Advance diagonals place by place: ``(start, length, period)`` of each as it breaks."""
    begin = before = lag = -1
    for place, q in zip([*places.tolist(), -1], [*lags.tolist(), -1], strict=True):
        if place == before + 1 and q == lag:
            before = place
            continue
        length = before - begin + grams + lag
        if lag > 0 and length >= max(MIN_WORDS, MIN_PERIODS * lag):
            yield begin - lag, length, lag
        begin = before = place
        lag = q


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per text all maximal runs ``(start, length, period)``, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    codes = _numbers(texts)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    longest = max(map(len, texts), default=0)
    places = np.flatnonzero(np.bincount(codes)[codes] > 1)
    codes = codes[places]
    step = 1  # the numbers stand for so many words; only those that occur twice are left
    while MIN_PERIODS * step <= longest and len(places):
        number = np.full(starts[-1] + 2 * step, -1, np.int64)
        number[places] = codes
        pairs = places[number[places + step] >= 0]
        names, count = _named(number[pairs], number[pairs + step])
        pairs, names = pairs[count > 1], names[count > 1]
        third = number[pairs + 2 * step]
        whole = third >= 0
        triples, _ = _named(names[whole], third[whole])
        lags = _nearest(pairs[whole], triples)
        near = (lags >= step) & (lags < 2 * step)
        for start, length, period in _walk(pairs[whole][near], lags[near], 3 * step):
            text = int(np.searchsorted(starts, start, side="right")) - 1
            found[text].append((start - int(starts[text]), length, period))
        places, codes, step = pairs, names, 2 * step
    for runs in found:
        runs.sort(key=lambda run: (run[0], run[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: of each run its first period is left."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _rows(texts: list[list[bytes]]) -> list[tuple[list[dict[str, int]], str]]:
    out = []
    for words, runs in zip(texts, runs_of(texts), strict=True):
        left = b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")
        out.append(([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], left))
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = pa.schema([*batch.schema, pa.field("runs", _RUNS), pa.field("collapsed", pa.string())])
        texts, size, begin = [], 0, 0
        for i, text in enumerate(batch["text"]):
            texts.append(words_of(text.as_py()))
            size += len(texts[-1])
            if size >= AT_ONCE or i + 1 == batch.num_rows:
                rows = _rows(texts)
                runs = pa.array([r for r, _ in rows], _RUNS)
                left = pa.array([c for _, c in rows], pa.string())
                part = batch.slice(begin, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, runs, left], schema=schema)
                texts, size, begin = [], 0, i + 1


_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``runs`` (array of start, length, period) and ``collapsed`` text of every row.

    Words are parted by ASCII white space and numbered from 0.  A run is a maximal stretch
    with smallest period q and at least ``max(6, 4 q)`` words; runs may overlap.
    ``collapsed`` joins the words that no run repeats by one space.  A null or empty text
    has no words, no runs and an empty ``collapsed``; a null id and repeated rows are kept as
    they are, other columns are ignored, an empty table gives no rows.  Texts are read whole
    and one by one: nothing is shuffled, and a task holds the words of one batch at most.
    """
    narrow = docs.select("doc_id", "text")
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text string, runs array<{RUN}>, collapsed string"
    return narrow.mapInArrow(_batches, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts as the query reads them: a tenth of them, by a checksum of the id, end in a period.

    With ``h = crc32(doc_id as text)``, ``g = h div 10`` and n words, a text with ``h % 10 = 0``
    repeats from word ``a = g % n`` on the ``p = 1 + (n - a) div (3 + g % 8)`` words there.
    Texts without words or without an id stay as they are.
    """
    text = text_or_empty()
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.filter(F.split(text, WHITE_SPACE), lambda w: w != "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    planted = F.concat_ws(" ", F.slice(words, F.lit(1), a), tail)
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & (n > 0)
    return docs.select("doc_id", F.when(chosen, planted).otherwise(text).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Per row the number of runs, the longest run, and hashes of all runs and of what is left."""
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    listed = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    less, start, period = (first.getField(name) for name in ("less", "start", "period"))
    milli = F.lit(-1000) * less
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        start.alias("start"),
        (-less).alias("length"),
        period.alias("period"),
        ((milli - milli % period) / period).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
