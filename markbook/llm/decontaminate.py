"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of each document pass through the automaton of the items; the longest
match that ends at a word tells whether a window of an item ends there.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.automaton import SuffixAutomaton
from markbook.llm.common import held, text_or_empty

WINDOW = 13
COVERAGE = 20  # contaminated when 1/20 of the words are hit
#: Text of items in one automaton.  Larger sets of items take one pass for each such part.
SHARD_BYTES = 2_000_000

# Bytes outside a word become spaces; A-Z become a-z; all bytes of non-ASCII letters stay.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Matcher:
    """Windows of a set of items, found in streams of words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.window = window
        self.names = [name for name, _ in items]
        self.automaton = automaton = SuffixAutomaton()
        #: Per state: the sizes of the short items it holds whole, and their numbers.
        self.short: dict[int, dict[int, set[int]]] = {}
        sequences = [words(text) for _, text in items]
        for number, sequence in enumerate(sequences):
            automaton.add(sequence, number)
        for number, sequence in enumerate(sequences):
            if 0 < len(sequence) < window:
                state = matched = 0
                for w in sequence:
                    state, matched = automaton.step(state, matched, w)
                self.short.setdefault(state, {}).setdefault(len(sequence), set()).add(number)
        self.least = min([window, *(size for held in self.short.values() for size in held)])
        self.items_of = automaton.numbers_below(window)
        self.window_items: dict[int, frozenset[int]] = {}
        self.short_items: dict[int, list[tuple[int, frozenset[int]]]] = {}

    def _window_items(self, state: int) -> frozenset[int]:
        """Items that hold the last ``window`` words of a match in this state."""
        found = self.window_items.get(state)
        if found is None:
            at, link, length = state, self.automaton.link, self.automaton.length
            while length[link[at]] >= self.window:
                at = link[at]
            found = self.window_items[state] = self.items_of[at]
        return found

    def _short_items(self, state: int) -> list[tuple[int, frozenset[int]]]:
        """Short items that are suffixes of a match in this state, with their sizes."""
        found = self.short_items.get(state)
        if found is None:
            found, at = [], state
            while at > 0:
                found += [(size, frozenset(numbers)) for size, numbers in self.short.get(at, {}).items()]
                at = self.automaton.link[at]
            self.short_items[state] = found
        return found

    def scan(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged ranges of hit words, stop exclusive, and the numbers of the items found."""
        follow, link, length = self.automaton.follow, self.automaton.link, self.automaton.length
        window, least, any_short = self.window, self.least, bool(self.short)
        spans: list[tuple[int, int]] = []
        numbers: set[int] = set()
        state = matched = 0
        for i, w in enumerate(sequence):
            to = follow[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = follow[state].get(w)
                if to is None:
                    state = matched = 0
                    continue
                matched = length[state]
            state = to
            matched += 1
            if matched < least:
                continue
            reach = 0
            if matched >= window:
                reach = window
                numbers |= self._window_items(state)
            if any_short:
                for size, found in self._short_items(state):
                    if size <= matched:
                        reach = max(reach, size)
                        numbers |= found
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, numbers


SCANNED = "n_words long, starts array<int>, stops array<int>, items array<string>"


def _scan(docs: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    """Adds the hit ranges and the items found to each row; ``body`` goes."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    key = hashlib.sha256(repr((window, items)).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = held(("benchmark", key), lambda: Matcher(sent.value, window))
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column("body"):
                sequence = words(text.as_py())
                spans, numbers = matcher.scan(sequence)
                out[0].append(len(sequence))
                out[1].append([a for a, _ in spans])
                out[2].append([b for _, b in spans])
                out[3].append([matcher.names[n] for n in numbers])
            columns = [pa.array(x, t) for x, t in zip(out, _SCANNED_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *columns],
                names=["row", "doc_id", "n_words", "starts", "stops", "items"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, doc_id {id_type}, {SCANNED}")


_SCANNED_TYPES = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    coverage: int = COVERAGE,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items, spans, contaminated``.

    A window is ``window`` consecutive words of an item, or all words of a shorter
    item.  ``spans`` are the ranges of hit words (stop exclusive), ``items`` the
    sorted ids of items with a window in the document.  Null or empty texts have no
    words and are never contaminated; items without words, and items with a null id,
    match nothing; items of equal text are all named; repeated document rows are
    judged one by one.  Extra columns are ignored.

    Items are counted first.  Up to ``shard_bytes`` of text they are one automaton;
    beyond, they are split by hash into parts of about that size, each part takes a
    pass, and the ranges of the passes are merged per document.  Documents are never
    shuffled; only ranges are, and only with several parts.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text")).where("name IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / shard_bytes))
    body = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"), text_or_empty("text").alias("body")
    )
    passes = []
    for part in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == part).collect()
        passes.append(_scan(body, sorted((r["name"], r["text"]) for r in chosen if r["text"]), window))
    if parts == 1:
        merged = passes[0].withColumn("spans", F.arrays_zip("starts", "stops"))
    else:
        scanned = passes[0]
        for more in passes[1:]:
            scanned = scanned.unionByName(more)
        merged = scanned.groupBy("row", "doc_id", "n_words").agg(
            F.flatten(F.collect_list("items")).alias("items"),
            F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "stops")))).alias("spans"),
        )
        merged = merged.withColumn("spans", _joined("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stops"] - s["starts"])
    judged = merged.withColumn("n_hit", n_hit).withColumn("items", F.array_sort(F.array_distinct("items")))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))).alias("contaminated"),
    )


def _joined(spans: str):
    """Sorted ranges with those that overlap or touch made one."""
    kind = "array<struct<starts:int,stops:int>>"
    return F.aggregate(
        spans,
        F.array().cast(kind),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stops"] >= s["starts"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["starts"].alias("starts"),
                        F.greatest(F.element_at(done, -1)["stops"], s["stops"]).alias("stops"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )


def digest(found: DataFrame) -> DataFrame:
    """The result with the item list as a hash."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
