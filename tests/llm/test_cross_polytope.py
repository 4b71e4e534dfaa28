from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from markbook.llm import cross_polytope as cp
from tests.llm.frames import CLASHING

SCHEMA = "vec_id long, embedding array<double>, label int, id long, vector string, " + CLASHING.replace("label string, ", "").replace(", id long", "")


def frame(spark, rows):
    blanks = [None] * (SCHEMA.count(",") - 1)
    return spark.createDataFrame([(i, None if v is None else [*v], *blanks) for i, v in rows], SCHEMA).repartition(3)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def plain(rows, is_query, count):
    """All products; a row that repeats counts once."""
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = {}
    for q, x in usable:
        if is_query(q):
            near = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in usable if i != q and len(y) == len(x))
            out[q] = [(rank, i, -s) for rank, (s, i) in enumerate(near[:count], 1)]
    return {q: v for q, v in out.items() if v}


def clustered(seed, rows, length, scale=1.0):
    draw = np.random.RandomState(seed)
    centres = draw.normal(size=(8, length))
    x = centres[draw.randint(8, size=rows)] + scale * draw.normal(size=(rows, length))
    return x / np.linalg.norm(x, axis=1)[:, None]


def recall(got, expected):
    pairs = sum(len(v) for v in expected.values())
    return sum(len({r[1] for r in got.get(q, ())} & {r[1] for r in v}) for q, v in expected.items()) / pairs


@pytest.mark.parametrize(("bucket_rows", "length"), [(4096, 24), (40, 16), (4, 16)])
def test_recall_and_exact_scores(spark, bucket_rows, length):
    x = clustered(1, 1200, length)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(cp.nearest_neighbours(frame(spark, rows), cp.every(), bucket_rows=bucket_rows))
    expected = plain(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(expected)
    assert recall(got, expected) >= 0.93
    for q, near in got.items():
        assert [r[0] for r in near] == list(range(1, 21))
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
        for _, i, s in near:
            assert s == pytest.approx(float(x[q] @ x[i]), abs=1e-12)


def test_lengths_that_differ(spark):
    draw = np.random.RandomState(2)
    x = clustered(2, 800, 12) * draw.uniform(0.2, 5, size=(800, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(cp.nearest_neighbours(frame(spark, rows), cp.every(10), count=10))
    assert recall(got, plain(rows, lambda i: i % 10 == 0, 10)) >= 0.93


def test_copies_and_ties_go_to_smaller_ids(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(i, one) for i in range(300)] + [(1000 + i, [0.0, 1.0, 0.0, 0.0]) for i in range(5)]
    got = found(cp.nearest_neighbours(frame(spark, rows + rows[:50]), cp.every(), recall=1.0))
    expected = plain(rows, lambda i: i % 20 == 0, 20)
    assert got == {q: expected[q] for q in expected}
    assert [r[1] for r in got[0]] == list(range(1, 21))
    assert [r[1] for r in got[1000]] == [1001, 1002, 1003, 1004, *range(16)]


def test_few_rows_and_odd_rows(spark):
    rows = [(0, [3.0, 4.0]), (20, [1.0, -0.0]), (40, [1.0, 0.0]), (41, [0.0, 0.0]), (42, None), (43, []), (60, [math.nan, 1.0]),
            (61, [math.inf, 1.0]), (80, [None, 1.0]), (None, [1.0, 1.0]), (-20, [-1.0, 2.0]), (100, [1.0, 2.0, 3.0]), (5, [1e-300, 0.0])]
    got = found(cp.nearest_neighbours(frame(spark, rows), cp.every(), recall=1.0))
    assert got == {
        0: [(1, -20, 5.0), (2, 20, 3.0), (3, 40, 3.0), (4, 5, 3e-300)],
        20: [(1, 0, 3.0), (2, 40, 1.0), (3, 5, 1e-300), (4, -20, -1.0)],
        40: [(1, 0, 3.0), (2, 20, 1.0), (3, 5, 1e-300), (4, -20, -1.0)],
        -20: [(1, 0, 5.0), (2, 5, -1e-300), (3, 20, -1.0), (4, 40, -1.0)],
    }
    huge = [(0, [1e200, 1e200]), (1, [-1e200, 1e200]), (20, [1e308, 0.0]), (21, [1e-320, 1.0])]
    assert set(found(cp.nearest_neighbours(frame(spark, huge), cp.every(), recall=1.0))) == {0, 20}


def test_an_id_with_several_vectors_and_no_queries(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    got = cp.nearest_neighbours(frame(spark, rows), cp.every(), recall=1.0).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == [(20, 3, 1.0)] * 2
    assert cp.nearest_neighbours(frame(spark, rows), F.col("id") > 50).count() == 0
    assert cp.nearest_neighbours(frame(spark, rows).where("false"), cp.every()).count() == 0


def test_large_buckets_meet_in_parts(spark, monkeypatch):
    x = clustered(5, 900, 16, 0.2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    whole = found(cp.nearest_neighbours(frame(spark, rows), cp.every(3)))
    monkeypatch.setattr(cp, "CELL_CANDIDATES", 20)
    monkeypatch.setattr(cp, "CELL_QUERIES", 10)
    assert found(cp.nearest_neighbours(frame(spark, rows), cp.every(3))) == whole
    monkeypatch.setattr(cp, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(cp, "_HELD", 5)
    assert found(cp.nearest_neighbours(frame(spark, rows), cp.every(3))) == whole


def test_rotations_keep_lengths_and_nearest_probes_come_first():
    x = clustered(3, 200, 48)
    for rows, parts in ((1000, [64]), (4_000_000, [64, 8]), (10**9, [64, 64, 16])):
        space = cp.Space(rows, 1.0, False)
        assert space.parts(48) == parts
        assert rows / np.prod([2 * p for p in space.parts(48)]) <= cp.BUCKET_ROWS
        probes = cp.probes_of(x, space, 1, 40)
        assert (probes[:, 0] == cp.buckets_of(x, space, 1)).all()
        assert all(len(set(p)) == 40 for p in probes.tolist())
    unit = cp._unit(x, space, True)
    assert np.allclose(cp._rotated(unit, 0, 0) @ cp._rotated(unit, 0, 0).T, x @ x.T)
    uneven = cp.Space(10, 2.0, True)
    both = cp._unit(x, uneven, True) @ cp._unit(x[:5], uneven, False).T
    assert np.allclose(both, x @ x[:5].T / 2)
    assert uneven.width(64) == 128


def test_probes_of_several_rotations_are_the_nearest_of_all():
    x = clustered(4, 5, 8)
    space = cp.Space(100, 1.0, False, bucket_rows=1)
    first, second = space.parts(8)
    near = [cp._axes(cp._unit(x, space, True), 0, part, axes) for part, axes in ((0, first), (1, second))]
    both = (near[0][:, :, None] + near[1][:, None, :]).reshape(5, -1)
    probes = cp.probes_of(x, space, 0, 30)
    assert np.allclose(np.take_along_axis(both, probes, 1), -np.sort(-both, axis=1)[:, :30], atol=1e-12)


def test_given_table(spark):
    from markbook.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = found(QUERIES["op12_nearest_neighbours"](spark, folder))
    expected = plain(table, lambda i: i % 20 == 0, 20)
    assert set(got) == set(expected)
    assert recall(got, expected) >= 0.93
