import itertools
import random
import tracemalloc

import numpy as np
import pytest

from markbook.llm import near_dedup
from markbook.llm.components import connected_components
from tests.llm.frames import ODD, edited, frame, odd_rows, prose


def sets_of(rows):
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        out.append((doc_id, grams))
    return out


def brute(rows):
    found = sets_of(rows)
    up = {i: i for i, _ in found if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, x), (j, y) in itertools.combinations([f for f in found if f[0] is not None and f[1]], 2):
        both = len(x & y)
        if 100 * both >= 75 * (len(x) + len(y) - both):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return sorted(((i, len(x), None if i is None else root(i), i is None or root(i) == i) for i, x in found), key=repr)


def test_components_match_brute_force(spark):
    rows = []
    for g in range(12):  # families of edited copies, some at the threshold, some of edits of edits
        text = prose(g, 60 + 10 * g)
        rows.append((g * 100, text))
        for k in range(1, 12):
            rows.append((g * 100 + k, edited(text, g * 50 + k, k % 6)))
        for k in range(12, 18):
            text = edited(text, g * 50 + k, 2)
            rows.append((g * 100 + k, text))
    hot = prose(77, 30)
    rows += [(5_000 + i, hot.upper() if i % 2 else hot) for i in range(80)]
    # A passage that many documents share, which are otherwise different.
    rows += [(6_000 + i, hot + " " + prose(900 + i, 25)) for i in range(60)]
    rows += [(7_000, "one two three"), (7_001, "ONE two\nthree"), (7_002, "one two")]
    rows += odd_rows(20_000)
    random.Random(3).shuffle(rows)
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_small_blocks_and_signatures_agree():
    rows = [(i, edited(prose(1, 80), i, 3)) for i in range(40)] + [(100 + i, prose(i, 80)) for i in range(20)]
    members = near_dedup._Members()
    sets = [near_dedup.shingles(near_dedup.words(t)) for _, t in rows]
    for (i, _), s in zip(rows, sets):
        members.add(i, i, s.tobytes(), near_dedup.signature(s).astype(np.uint8).tobytes())
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in members.joins(75):
        x, y = sorted((root(a), root(b)))
        assert x != y  # a forest
        up[y] = x
    assert sorted(root(i) for i, _ in rows) == sorted(c for _, _, c, _ in brute(rows))


def test_signature_estimates_the_overlap():
    one, two = prose(5, 3000, 10**6), edited(prose(5, 3000, 10**6), 1, 120)
    x, y = (near_dedup.shingles(near_dedup.words(t)) for t in (one, two))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((near_dedup.signature(x) == near_dedup.signature(y)).mean() - true) < 0.15


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    found = near_dedup.shingles(near_dedup.words(text))
    assert len(found) == len(sets_of([(1, text)])[0][1])


def test_empty_table(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in near_dedup.near_duplicates(frame(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]


def test_connected_components(spark):
    draw = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(draw.randrange(100, 180), draw.randrange(100, 180)) for _ in range(50)]
    links += [(200, 201), (201, 200), (200, 201), (300, 300), (None, 1), (2, None), (400, 500), (450, 500)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = want.get(a, a), want.get(b, b)
            want |= {a: x, b: y}
            low, high = min(x, y), max(x, y)
            want = {n: low if c == high else c for n, c in want.items()}
    assert got == want


def test_large_sets_meet_by_ranges_of_hashes():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**64, 30_000, dtype=np.uint64)
    members, sets = near_dedup._Members(), {}
    for i in range(160):  # every second one shares nine tenths with the others, the rest nothing
        own = draw.integers(0, 2**64, 30_000 if i % 2 else 3_000, dtype=np.uint64)
        sets[i] = np.unique(own if i % 2 else np.concatenate([base[:27_000], own]))
        members.add(i, i, sets[i].tobytes(), bytes(200))
    tracemalloc.start()
    links = members.joins(75)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all of the sets at once: 38 MB, five times over
    assert len(links) == 79 and all(a % 2 == b % 2 == 0 for a, b in links)
    pairs = [(0, np.array([1, 2, 4])), (3, np.array([5, 6]))]
    for i, other, counts in near_dedup._common([sets[i] for i in range(8)], pairs):
        assert counts.tolist() == [len(np.intersect1d(sets[i], sets[j])) for j in other]
