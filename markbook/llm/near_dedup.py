"""Near duplicates by min-max hashing.

Each permutation of the shingles gives two signature values, the minimum and the
maximum, for one evaluation of the hash.  Bands of values propose pairs; every
link is confirmed on the full shingle sets.

1. Texts of equal word sequences are one class; its smallest id stands for it.
2. In each bucket of a band every member is compared with the bucket's smallest id.
   The confirmed links make components.
3. Buckets whose other members still belong to different components are compared
   member by member across components, in blocks of bounded size and in matrix
   form.  Only links that join two components leave a task.

So every pair that shares a bucket is either confirmed, refused, or in one component
already, and no step lists all pairs of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import by_ids, held, salted_join, stage, text_or_empty
from markbook.llm.components import connected_components

SHINGLE = 5
PERCENT = 75
#: 40 bands of 5 values, from 100 permutations: a pair at the threshold shares no band
#: with a probability of (1 - 0.75^5)^40 = 2e-5.
ROWS = 5
BANDS = 40
#: Share of equal signature values below which a pair is not compared: 6 standard
#: deviations below the threshold.
LEAST_ESTIMATE = 0.55
BLOCK = 512
#: Hashes of a block's sets that are met at a time.
AT_ONCE = 1 << 19

_COUNT = (ROWS * BANDS + 1) // 2
_FACTORS = np.array([xxhash.xxh32_intdigest(b"factor %d" % i) | 1 for i in range(_COUNT)], dtype=np.uint32)
_SHIFTS = np.array([xxhash.xxh32_intdigest(b"shift %d" % i) for i in range(_COUNT)], dtype=np.uint32)


class _WordHashes(dict):
    """64-bit hashes of words, as bytes."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_digest(word)
        return value


def word_hashes(sequence: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    known = held("word hashes", _WordHashes)
    return np.frombuffer(b"".join(map(known.__getitem__, sequence)), dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z as a-z."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(sequence: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a short sequence is one shingle."""
    if not sequence:
        return np.empty(0, dtype=np.uint64)
    each = word_hashes(sequence)
    count = max(len(each) - size + 1, 1)
    mixed = np.full(count, min(len(each), size), dtype=np.uint64)
    for i in range(min(size, len(each))):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + each[i : i + count]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the shingles under each permutation, side by side."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(_COUNT, 0xFFFFFFFF, dtype=np.uint32)
    high = np.zeros(_COUNT, dtype=np.uint32)
    for at in range(0, len(short), 4096):
        values = short[None, at : at + 4096] * _FACTORS[:, None] + _SHIFTS[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    out = np.empty(2 * _COUNT, dtype=np.uint32)
    out[0::2], out[1::2] = low, high
    return out[: ROWS * BANDS]


def bands(values: np.ndarray) -> list[int]:
    """One key per band; the band's number is part of it."""
    return [
        int.from_bytes(xxhash.xxh3_64_digest(values[b * ROWS : (b + 1) * ROWS].tobytes(), b), "little", signed=True)
        for b in range(BANDS)
    ]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, classes, keys = [], [], []
        for text in batch.column("body"):
            sequence = words(text.as_py())
            found = shingles(sequence)
            counts.append(len(found))
            classes.append(hashlib.blake2b(b" ".join(sequence), digest_size=16).digest() if sequence else None)
            keys.append(bands(signature(found)) if sequence else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(counts, pa.int64()),
                pa.array(classes, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "class", "bands"],
        )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, signs = [], []
        for text in batch.column("body"):
            found = shingles(words(text.as_py()))
            sets.append(found.tobytes())
            signs.append(signature(found).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sets, pa.binary()), pa.array(signs, pa.binary())], names=["id", "set", "sign"]
        )


def _linked(common: int, left: int, right: int, percent: int) -> bool:
    return 100 * common >= percent * (left + right - common)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("set"), batch.column("other"), strict=True):
                x, y = (np.frombuffer(s.as_py(), dtype=np.uint64) for s in (left, right))
                near = 100 * min(len(x), len(y)) >= percent * max(len(x), len(y))
                keep.append(
                    near and _linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)
                )
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Members:
    """Members of one bucket, or of two of its blocks."""

    def __init__(self) -> None:
        self.rows: dict[int, tuple[int, bytes, bytes]] = {}

    def add(self, number: int, component: int, found: bytes, sign: bytes) -> None:
        self.rows[number] = (component, found, sign)

    def joins(self, percent: int) -> list[tuple[int, int]]:
        """Links that join different components: a forest of them."""
        rows = list(self.rows.items())
        component = np.array([r[1][0] for r in rows])
        names, sizes = np.unique(component, return_counts=True)
        if len(names) < 2:
            return []
        sets = [np.frombuffer(r[1][1], dtype=np.uint64) for r in rows]
        length = np.array([len(s) for s in sets])
        signs = np.frombuffer(b"".join(r[1][2] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
        # Members of the largest component need no comparison among themselves.
        outside = np.flatnonzero(component != names[sizes.argmax()])
        pairs = []
        for i in outside.tolist():
            fits = 100 * np.minimum(length, length[i]) >= percent * np.maximum(length, length[i])
            other = np.flatnonzero(fits & (component != component[i]))
            if len(other):
                alike = (signs[other] == signs[i]).mean(axis=1) >= LEAST_ESTIMATE
                pairs.append((i, other[alike]))
        return self._forest(rows, sets, length, component, pairs, percent)

    def _forest(self, rows, sets, length, component, pairs, percent) -> list[tuple[int, int]]:
        parent = {c: c for c in component.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        out = []
        for common in _common(sets, pairs):
            i, other, counts = common
            near = 100 * counts >= percent * (length[i] + length[other] - counts)
            for j in other[near].tolist():
                x, y = root(int(component[i])), root(int(component[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((rows[i][0], rows[j][0]))
        return out


def _common(sets: list[np.ndarray], pairs: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sizes of the intersections of each first member with its others, as matrix products.

    The sets are sorted hashes: they are met by ranges of hashes, so that what is copied
    of them has a bound, and the sizes are summed over the ranges.
    """
    pairs = [(i, other) for i, other in pairs if len(other)]
    if not pairs:
        return
    used = np.unique(np.concatenate([[i for i, _ in pairs], *[other for _, other in pairs]]))
    chosen = [sets[m] for m in used]
    firsts = np.searchsorted(used, [i for i, _ in pairs])
    ranges = sum(map(len, chosen)) // AT_ONCE + 1
    total = np.zeros((len(firsts), len(used)), dtype=np.float32)
    ends = np.zeros(len(used), dtype=np.int64)
    for k in range(1, ranges + 1):
        begins = ends
        if k < ranges:
            limit = np.uint64((k << 64) // ranges)
            ends = np.array([np.searchsorted(s, limit) for s in chosen])
        else:
            ends = np.array([len(s) for s in chosen])
        _add_common([s[a:b] for s, a, b in zip(chosen, begins, ends, strict=True)], firsts, total)
    for (i, other), row in zip(pairs, total, strict=True):
        yield i, other, row[np.searchsorted(used, other)].astype(np.int64)


def _add_common(sets: list[np.ndarray], firsts: np.ndarray, total: np.ndarray) -> None:
    """Add the sizes of the intersections of some members (rows) with all (columns)."""
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times[inverse] > 1  # what one member has alone is in no intersection
    renamed = np.cumsum(times > 1) - 1
    column, owner = renamed[inverse[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = int((times > 1).sum())
    for low in range(0, width, 2048):
        a, b = np.searchsorted(column, (low, low + 2048))
        flags = np.zeros((len(sets), min(2048, width - low)), dtype=np.float32)
        flags[owner[a:b], column[a:b] - low] = 1
        for start in range(0, len(firsts), 512):
            total[start : start + 512] += flags[firsts[start : start + 512]] @ flags.T


def _across(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, current = _Members(), None

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())],
                names=["a", "b"],
            )

        for batch in batches:
            names = ("key", "one", "two", "id", "component", "set", "sign")
            for key, one, two, *row in zip(*(batch.column(c) for c in names), strict=True):
                place = key.as_py(), one.as_py(), two.as_py()
                if place != current:
                    yield out(members.joins(percent))
                    members, current = _Members(), place
                members.add(*(value.as_py() for value in row))
        yield out(members.joins(percent))

    return run


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, set, sign`` of the texts of some ids, staged."""
    body = by_ids(docs.select(F.col("doc_id").alias("id"), text_or_empty("text").alias("body")), ids, "left_semi", "id")
    # A repeated id stands for one document: rows of one id with different texts are told apart by class before.
    return stage(body.mapInArrow(_shingle_sets, "id long, set binary, sign binary"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when their sets of distinct word 5-shingles (A-Z
    lower-cased, words split at ASCII white space) overlap by ``percent`` of their
    union; a document of fewer words has one shingle.  ``component_id`` is the smallest
    id reachable; the document of that id is kept.  Null and empty texts have no
    shingles and are linked with nothing; so are rows with a null id, which are kept
    and have a null component.  Equal rows get equal answers; ids are to be unique
    otherwise: the texts of one id count as linked.  Extra columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("body"))
    signed = stage(body.mapInArrow(_sign, "doc_id long, n_shingles long, class binary, bands array<long>"))
    known = signed.where("doc_id IS NOT NULL AND class IS NOT NULL")
    classes = stage(known.groupBy("class").agg(F.min("doc_id").alias("first")))
    firsts = known.select("doc_id", "class", "bands").join(
        classes.select("class", F.col("first").alias("doc_id")), ["class", "doc_id"], "left_semi"
    )
    members = stage(firsts.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id")))
    buckets = members.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = stage(salted_join(members, buckets, ["key"]))

    stars = stage(placed.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    sets = _sets_of(docs, placed.select("id"))
    compared = salted_join(
        stars.join(sets.select(F.col("id").alias("b"), F.col("set").alias("other")), "b"),
        sets.select(F.col("id").alias("a"), "set"),
        ["a"],
        salts=8,
    )
    confirmed = stage(compared.select("a", "b", "set", "other").mapInArrow(_confirm(percent), "a long, b long"))
    first_round = stage(connected_components(confirmed))

    # Members other than the hub that lie in different components.
    rest = salted_join(
        placed.where("id <> hub"), first_round.withColumnRenamed("node", "id"), ["id"], "left", salts=4
    ).withColumn("component", F.coalesce("component", "id"))
    open_buckets = (
        rest.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
        .where("low <> high")
        .select("key", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int").alias("blocks"))
    )
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    spread = (
        salted_join(rest.select("key", "id", "component"), open_buckets, ["key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "key",
            F.least("own", "other").alias("one"),
            F.greatest("own", "other").alias("two"),
            "id",
            "component",
        )
    )
    dealt = (
        spread.join(sets, "id")
        .select("key", "one", "two", "id", "component", "set", "sign")
        .repartition("key", "one", "two")
        .sortWithinPartitions("key", "one", "two")
    )
    joined = stage(dealt.mapInArrow(_across(percent), "a long, b long"))
    final = connected_components(confirmed.unionByName(joined))

    named = classes.join(final.withColumnRenamed("node", "first"), "first", "left").select(
        "class", F.coalesce("component", "first").alias("component")
    )
    found = salted_join(signed.select("doc_id", "n_shingles", "class"), named, ["class"], "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return found.select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        "n_shingles",
        component.cast(kind).alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
