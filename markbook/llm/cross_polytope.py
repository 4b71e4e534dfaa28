"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (random signs and a fast Hadamard transform, three times) turns a unit
vector, and the nearest signed axis is its bucket; with many rows a table takes more such
rotations, so that buckets stay small.  A query looks into the buckets of its table in
the order in which their axes are near to it (multiprobe).  How many it needs is
fitted: the exact neighbours of a bounded sample of queries, searched among all rows,
tell the fewest probes that reach the wanted recall.  Candidates are ranked again by
exact inner products.

Rows of equal vectors are one class, which carries the smallest ids that any answer can
hold; so a vector that a third of all rows share is hashed, sent and compared once.
Inner products of vectors of different length are searched as cosines with one more
component: x / M and sqrt(1 - |x|^2 / M^2), with M the greatest length of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markbook.llm.common import salted_join, stage

NEAREST = 20
#: Rows whose id is divisible by this are queries.
QUERY_EVERY = 20
TABLES = 4
#: A table gets another rotation where its buckets would hold more rows than this on average.
BUCKET_ROWS = 4096
#: The sample that fits the number of probes: queries, and the recall they are to reach.
SAMPLE_QUERIES = 256
SAMPLE_RECALL = 0.97
#: Probes tried at most; where they do not do, the table gets fewer buckets.
MOST_PROBES = 4096
#: Rows of a bucket that meet in one cell: candidates, queries.
CELL_CANDIDATES = 4096
CELL_QUERIES = 1024
#: Cells of large buckets up to which they are sent to every executor (some 40 bytes each).
BROADCAST_CELLS = 100_000
#: Queries whose best candidates a task holds before it hands them on.
_HELD = 20_000
_SEED = 20_011
_UNSEEN = 1 << 30
_PAIR = np.dtype([("score", "<f8"), ("least", "<i8"), ("key", "V16")])
_PROBED = np.dtype([*_PAIR.descr, ("probe", "<i4")])


class Space(NamedTuple):
    """What hashing needs to know of all rows: how many classes, their greatest length, whether lengths differ."""

    rows: int
    longest: float
    uneven: bool
    bucket_rows: int = BUCKET_ROWS

    def width(self, length: int) -> int:
        """Components after padding, a power of two."""
        return 1 << max(length + self.uneven - 1, 1).bit_length()

    def parts(self, length: int) -> list[int]:
        """Axes that each rotation of a table looks at; twice the product of all is the number of buckets."""
        parts = [self.width(length)]
        buckets = 2 * parts[0]
        while self.rows / buckets > self.bucket_rows:
            more = min(parts[0], 1 << max(int(self.rows / buckets / self.bucket_rows) - 1, 0).bit_length())
            parts.append(more)
            buckets *= 2 * more
        return parts


@lru_cache(maxsize=64)
def _signs(table: int, part: int, width: int) -> np.ndarray:
    return np.random.RandomState([_SEED, table, part, width]).choice([-1.0, 1.0], size=(3, width))


def _rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    rows, width = x.shape
    for signs in _signs(table, part, width):
        x = x * signs
        half = 1
        while half < width:
            pairs = x.reshape(rows, width // (2 * half), 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
            half *= 2
        x = x.reshape(rows, width) / np.sqrt(width)
    return x


def _lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also where squares are too large or too small for doubles."""
    most = np.abs(x).max(axis=1)
    with np.errstate(over="ignore"):
        out = most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))
    return np.minimum(out, np.finfo(float).max)


def _unit(x: np.ndarray, space: Space, query: bool) -> np.ndarray:
    """Unit vectors, padded: queries by their own length, rows by the greatest one and the rest as one component."""
    rows, length = x.shape
    out = np.zeros((rows, space.width(length)))
    lengths = _lengths(x)
    with np.errstate(over="ignore", under="ignore"):
        out[:, :length] = x / np.abs(x).max(axis=1)[:, None]
        out /= np.sqrt((out**2).sum(axis=1))[:, None]
        if space.uneven and not query:
            share = lengths / space.longest
            out *= share[:, None]
            out[:, length] = np.sqrt(np.maximum(0, 1 - share**2))
    return out


def _axes(unit: np.ndarray, table: int, part: int, axes: int) -> np.ndarray:
    """How near each signed axis is, the axes and then their opposites."""
    turned = _rotated(unit, table, part)[:, :axes]
    return np.concatenate([turned, -turned], axis=1)


def buckets_of(x: np.ndarray, space: Space, table: int) -> np.ndarray:
    """The bucket of every row in a table."""
    unit = _unit(x, space, False)
    out = np.zeros(len(x), np.int64)
    for part, axes in enumerate(space.parts(x.shape[1])):
        out = out * (2 * axes) + _axes(unit, table, part, axes).argmax(axis=1)
    return out


def probes_of(x: np.ndarray, space: Space, table: int, probes: int) -> np.ndarray:
    """For every query its buckets in a table, the nearest first, at most ``probes`` of them."""
    unit = _unit(x, space, True)
    near, codes = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for part, axes in enumerate(space.parts(x.shape[1])):
        own = _axes(unit, table, part, axes)
        best = np.argsort(-own, axis=1, kind="stable")[:, :probes]
        both = (near[:, :, None] + np.take_along_axis(own, best, 1)[:, None, :]).reshape(len(x), -1)
        codes = (codes[:, :, None] * (2 * axes) + best[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        near, codes = np.take_along_axis(both, order, 1), np.take_along_axis(codes, order, 1)
    return codes


def products(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of one vector with rows, summed in the same order wherever they are worked out."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((rows * query).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf) + 0.0


def _best(pairs: np.ndarray, count: int) -> np.ndarray:
    """The first by score, then least id; a class that came twice counts once."""
    pairs = pairs[np.lexsort((pairs["least"], -pairs["score"]))]
    _, first = np.unique(pairs["key"], return_index=True)
    return pairs[np.sort(first)][:count]


def _top(
    query: np.ndarray, keys: np.ndarray, least: np.ndarray, rows: np.ndarray, rough: np.ndarray, count: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places and pairs of one query's best rows, chosen by rough products and scored exactly."""
    place = np.arange(len(rough))
    if len(rough) > count:
        bound = np.partition(rough, len(rough) - count)[len(rough) - count]
        with np.errstate(over="ignore", invalid="ignore"):  # what rounding may have moved stays in
            place = np.flatnonzero(~(rough < bound - 1e-12 * np.abs(query).sum() * np.abs(rows).max()))
    out = np.empty(len(place), _PAIR)
    out["key"], out["least"], out["score"] = keys[place], least[place], products(query, rows[place])
    return place, out


def _rough(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(queries @ rows.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)


# Vectors travel as the bytes of their doubles.

CLASS = "key binary, length int, least long, vector binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable rows with their vectors as bytes; equal vectors have equal bytes."""
    for batch in batches:
        ids, vectors = [], []
        for number, vector in zip(batch["id"].to_pylist(), batch["vector"].to_pylist(), strict=True):
            if number is None or not vector or None in vector:
                continue
            doubles = np.array(vector, np.float64) + 0.0  # a negative zero equals zero
            if np.isfinite(doubles).all() and doubles.any():
                ids.append(number)
                vectors.append(doubles.tobytes())
        lengths = [_lengths(np.frombuffer(v).reshape(1, -1))[0] for v in vectors]
        arrays = [pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(lengths, pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "vector", "norm"])


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    data = vectors.to_pylist()
    return np.frombuffer(b"".join(data)).reshape(len(data), -1)


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "V16")


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lengths = batch["length"].to_numpy()
    for length in np.unique(lengths):
        yield batch.filter(pa.array(lengths == length))


def _classes(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Usable ids with the key of their vector; distinct vectors with least id and length; each one's smallest ids."""
    packed = vectors.mapInArrow(_packed, "id long, vector binary, norm double")
    usable = stage(packed.select(F.unhex(F.md5("vector")).alias("key"), "*"))
    classes = usable.groupBy("key").agg(
        F.min("id").alias("least"), F.min("vector").alias("vector"), F.max("norm").alias("norm")
    )
    ids = usable.select("key", "id").distinct()
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    members = ids.withColumn("place", place).where(F.col("place") <= keep).drop("place")
    return ids, stage(classes.withColumn("length", (F.length("vector") / 8).cast("int"))), stage(members)


def _fitted(classes: DataFrame, queries: DataFrame, space: Space, count: int, tables: int, recall: float) -> int | None:
    """The fewest probes per table by which sampled queries find their exact neighbours; None if too many."""
    asked: dict[int, list[tuple[bytes, bytes]]] = {}
    sample = queries.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_QUERIES)
    for row in sample.select("key", "length", "vector").collect():
        asked.setdefault(row["length"], []).append((bytes(row["key"]), bytes(row["vector"])))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per sampled query the best of the rows of a task, and the first probe that finds each."""
        best: dict[bytes, np.ndarray] = {}
        order = {}
        for length, pairs in asked.items():
            x, most = _matrix(pa.array([v for _, v in pairs])), max(MOST_PROBES, 2 * space.width(length))
            order[length] = x, [probes_of(x, space, t, most) for t in range(tables)]
        for batch in (part for whole in batches for part in _by_length(whole)):
            length = batch["length"][0].as_py()
            if length not in asked:
                continue
            keys, rows, least = _keys(batch["key"]), _matrix(batch["vector"]), batch["least"].to_numpy()
            x, probes = order[length]
            codes = [buckets_of(rows, space, t) for t in range(tables)]
            rough = _rough(x, rows)
            for i, (key, _) in enumerate(asked[length]):
                place, pairs = _top(x[i], keys, least, rows, rough[i], count + 1)
                told = np.empty(len(place), _PROBED)
                for name in _PAIR.names:
                    told[name] = pairs[name]
                told["probe"] = _UNSEEN
                for looked, code in zip(probes, codes, strict=True):
                    hit, at = np.nonzero(code[place][:, None] == looked[i][None, :])
                    told["probe"][hit] = np.minimum(told["probe"][hit], at)
                best[key] = _best(np.concatenate([best[key], told]) if key in best else told, count + 1)
        rows = [
            (key, float(pair["score"]), int(pair["least"]), int(pair["probe"]))
            for key, pairs in best.items()
            for pair in pairs
            if pair["key"].tobytes() != key
        ]
        if rows:
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FOUND.types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_FOUND)

    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "least"))
    told = classes.mapInArrow(exact, "key binary, score double, least long, probe int").withColumn("place", place)
    ranks = np.array([r["probe"] for r in told.where(F.col("place") <= count).select("probe").collect()])
    if not len(ranks):
        return 1
    probes = int(np.quantile(ranks, recall, method="higher")) + 1
    return probes if probes <= _UNSEEN else None


_FOUND = pa.schema([("key", pa.binary()), ("score", pa.float64()), ("least", pa.int64()), ("probe", pa.int32())])
_CODED = pa.schema([("key", pa.binary()), ("length", pa.int32()), ("least", pa.int64()), ("vector", pa.binary()),
                    ("table", pa.int32()), ("bucket", pa.int64())])
_CODED_DDL = f"{CLASS}, table int, bucket long"


def _coded(rows: DataFrame, space: Space, tables: int, probes: int | None) -> DataFrame:
    """Each row once per table with its bucket; a query, with ``probes``, once per bucket it looks into."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _by_length(whole)):
            x = _matrix(batch["vector"])
            for begin in range(0, len(x), 256):
                part, chunk = batch.slice(begin, 256), x[begin : begin + 256]
                for table in range(tables):
                    if probes is None:
                        buckets = buckets_of(chunk, space, table)[:, None]
                    else:
                        buckets = probes_of(chunk, space, table, probes)
                    each = part.take(pa.array(np.repeat(np.arange(len(chunk)), buckets.shape[1])))
                    columns = [each[name] for name in ("key", "length", "least", "vector")]
                    columns += [pa.array(np.full(buckets.size, table, np.int32)), pa.array(buckets.ravel())]
                    yield pa.RecordBatch.from_arrays(columns, schema=_CODED)

    return rows.select("key", "length", "least", "vector").mapInArrow(code, _CODED_DDL)


_CELL = ["length", "table", "bucket"]


def _in_cells(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows and queries by cell: a bucket, or a part of a large one."""
    side = F.lit(1).alias("query")
    sizes = rows.select(*_CELL, F.lit(0).alias("query")).unionByName(asked.select(*_CELL, side)).groupBy(*_CELL).agg(
        F.ceil(F.sum(1 - F.col("query")) / CELL_CANDIDATES).cast("int").alias("row_parts"),
        F.ceil(F.sum("query") / CELL_QUERIES).cast("int").alias("query_parts"),
    )
    large = stage(sizes.where("row_parts > 1 OR query_parts > 1"))
    if large.count() <= BROADCAST_CELLS:
        large = F.broadcast(large)

    def dealt(df: DataFrame, own: str, other: str, query: int) -> DataFrame:
        part = F.pmod(F.xxhash64("key"), F.greatest(F.coalesce(own, F.lit(1)), F.lit(1))).cast("int")
        all_others = F.sequence(F.lit(0), F.greatest(F.coalesce(other, F.lit(1)), F.lit(1)) - 1)
        return (
            df.join(large, _CELL, "left")
            .select("*", part.alias(own.replace("parts", "part")), F.explode(all_others).alias(other.replace("parts", "part")))
            .select("key", "least", "vector", *_CELL, "row_part", "query_part", F.lit(query).alias("query"))
        )

    return dealt(rows, "row_parts", "query_parts", 0).unionByName(dealt(asked, "query_parts", "row_parts", 1))


def _meet(count: int):
    """Queries of a cell meet its rows; each query's best so far leave the task as one block."""

    def blocks(best: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        keys, pairs = list(best), [p.tobytes() for p in best.values()]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(pairs, pa.binary())], names=["key", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, np.ndarray] = {}
        cell, asked, x = None, [], np.empty((0, 0))
        for batch in batches:
            names = np.stack([batch[c].to_numpy().astype(np.int64) for c in [*_CELL, "row_part", "query_part", "query"]], axis=1)
            cuts = np.flatnonzero(np.any(names[1:] != names[:-1], axis=1)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(names)], strict=True):
                part, name = batch.slice(begin, end - begin), tuple(names[begin][:5])
                if name != cell:
                    cell, asked, x = name, [], np.empty((0, 0))
                    if len(best) > _HELD:
                        yield blocks(best)
                        best = {}
                if names[begin][5]:  # queries come first
                    asked += part["key"].to_pylist()
                    more = _matrix(part["vector"])
                    x = np.concatenate([x, more]) if len(x) else more
                elif asked:
                    keys, rows, least = _keys(part["key"]), _matrix(part["vector"]), part["least"].to_numpy()
                    rough = _rough(x, rows)
                    for i, key in enumerate(asked):
                        _, top = _top(x[i], keys, least, rows, rough[i], count)
                        best[key] = _best(np.concatenate([best[key], top]) if key in best else top, count)
        if best:
            yield blocks(best)

    return run


def _merged(count: int):
    """The blocks of each query, which come one after the other, as rows of its best candidates."""

    def rows(key: bytes, parts: list[np.ndarray]) -> pa.RecordBatch:
        pairs = _best(np.concatenate(parts), count)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key] * len(pairs), pa.binary()),
                pa.array([k.tobytes() for k in pairs["key"]], pa.binary()),
                pa.array(pairs["score"]),
            ],
            names=["asked", "key", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            for key, pairs in zip(batch["key"].to_pylist(), batch["pairs"].to_pylist(), strict=True):
                if key != last and parts:
                    yield rows(last, parts)
                    parts = []
                last = key
                parts.append(np.frombuffer(pairs, _PAIR))
                if len(parts) > 64:
                    parts = [_best(np.concatenate(parts), count)]
        if parts:
            yield rows(last, parts)

    return run


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    count: int = NEAREST,
    tables: int = TABLES,
    recall: float = SAMPLE_RECALL,
    bucket_rows: int = BUCKET_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the rows of greatest inner product.

    ``is_query`` is a condition on the column ``id``.  Nearest come first, ties by smaller id; a
    query is not its own neighbour.  Rows without an id, and vectors that are null, empty,
    zero or hold a null or a component that is not finite, take no part; vectors of
    different dimension do not meet.  A row that repeats with id and vector counts once; an
    id with several vectors is a row, and a query, with each.  Other columns are ignored;
    an empty table gives no rows.  Candidates come from ``tables`` hash tables, the number
    of probes from a sample of ``SAMPLE_QUERIES`` queries; scores are exact.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    ids, classes, members = _classes(rows, count + 1)
    told = classes.agg(F.count(F.lit(1)), F.max("norm"), F.min("norm")).head()
    asked_ids = stage(ids.where(is_query))
    queries = stage(classes.join(asked_ids.select("key").distinct(), "key", "left_semi"))
    space = Space(told[0], told[1] or 1.0, bool(told[0]) and told[2] < told[1] * (1 - 1e-6), bucket_rows)
    while (probes := _fitted(classes, queries, space, count, tables, recall)) is None:
        space = space._replace(bucket_rows=space.bucket_rows * 8)
    cells = _in_cells(_coded(classes, space, tables, None), _coded(queries, space, tables, probes))
    parts = [*_CELL, "row_part", "query_part"]
    met = (
        cells.repartition(*[F.col(c) for c in parts])
        .sortWithinPartitions(*parts, F.desc("query"))
        .mapInArrow(_meet(count + 1), "key binary, pairs binary")
    )
    found = met.repartition("key").sortWithinPartitions("key").mapInArrow(_merged(count + 1), "asked binary, key binary, score double")
    # Classes become rows again: the best ids of each query vector, one of which may be the query's own.
    listed = found.join(members, "key")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))
    lists = (
        listed.withColumn("place", place)
        .where(F.col("place") <= count + 1)
        .groupBy(F.col("asked").alias("key"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("best"))
    )
    answered = salted_join(asked_ids, lists, ["key"])
    others = F.filter("best", lambda b: b["id"] != F.col("id"))
    return answered.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, count)).alias("place", "b")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score")
    )


def every(ids: int = QUERY_EVERY) -> Column:
    """The query set: rows whose id is divisible by ``ids``."""
    return F.col("id") % ids == 0
