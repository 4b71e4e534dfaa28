import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from markbook.llm import packing
from tests.llm.frames import frame, odd_rows, prose


def whole_ids(rows):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER_FILE)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows]


def checked(pieces, rows, size=2048):
    """Every id of every document once, sequences without gaps; returns padding and tokens."""
    ids = whole_ids(rows)
    fits = {}
    for i, (doc_id, _) in enumerate(rows):
        fits.setdefault((doc_id, len(ids[i])), []).append(i)
    by_document, by_sequence = {}, {}
    for p in pieces:
        assert p["length"] > 0
        by_document.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_document.keys() == fits.keys()
    for key, same in fits.items():
        left = sorted(by_document[key], key=lambda p: (p["start"], p["sequence_id"]))
        assert sum(p["length"] for p in left) == key[1] * len(same)
        for p in left:
            part = ids[same[0]][p["start"] : p["start"] + p["length"]]
            assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == p["ids_crc32"]
    padding = 0
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, sum(map(len, ids))


def test_round_trip(spark):
    rows = [(i, prose(i, 20 + 37 * (i % 40)) + ("." if i % 2 else " end! And more? yes")) for i in range(120)]
    rows += odd_rows()
    pieces = packing.pack(frame(spark, rows)).collect()
    padding, tokens = checked(pieces, rows)
    assert padding <= 0.03 * tokens


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = packing.pack(docs).collect()
    padding, tokens = checked(pieces, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert padding <= 0.01 * tokens


def test_order_is_kept(spark):
    rows = [(i, prose(i, 300)) for i in range(40)]
    docs = frame(spark, rows).repartition(1).sortWithinPartitions("n_chars", "doc_id")
    order = [r["doc_id"] for r in docs.collect()]
    pieces = packing.pack(docs).orderBy("sequence_id", "offset").collect()
    assert [k for k, _ in itertools.groupby(p["doc_id"] for p in pieces)] == order


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_cuts_are_the_cheapest(seed):
    draw = random.Random(seed)
    size = 16
    places, costs = [0], [0]
    for _ in range(draw.randrange(1, 12)):
        places.append(places[-1] + draw.randrange(1, 9))
        costs.append(draw.choice([0, 2, 5]))
    powers = [1, 2, 4, 8, 16]
    best = min(
        sum(costs[c] for c in cuts[1:]) + sum(pad(b - a, size) for a, b in windows)
        for k in range(len(places) - 1)
        for middle in itertools.combinations(range(1, len(places) - 1), k)
        for cuts in [[0, *middle, len(places) - 1]]
        for windows in [[(places[a], places[b]) for a, b in zip(cuts, cuts[1:])]]
        if all(b - a <= size for a, b in windows)
    )
    cuts = packing.choose_cuts(places, costs, size, powers)
    windows = [(places[a], places[b]) for a, b in zip(cuts, cuts[1:])]
    assert all(b - a <= size for a, b in windows)
    assert sum(costs[c] for c in cuts[1:]) + sum(pad(b - a, size) for a, b in windows) == best


def pad(length, size):
    return 0 if length & (length - 1) == 0 else size - length


@pytest.mark.parametrize("seed", range(5))
def test_encoder_equals_the_tokenizer(seed):
    draw = random.Random(seed)
    encoder = packing.Encoder(packing.TOKENIZER_FILE, keep=50)
    letters = [chr(c) for c in range(256)] + ["'s", "'LL", " ", "é", "é", "ß", "İ", "Σ", "½", "<|endoftext|>", "中文"]
    for k in range(200):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(50)))
        if k % 2:  # only what the fast way takes
            text = "".join(c for c in text if c in "\t\n\r" or " " <= c <= "~" or "\xa1" <= c <= "\xff")
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(want, dtype="<u4").tobytes()


def test_a_document_of_several_lines():
    ids = np.arange(5_000, dtype="<u4") % 7
    packer = packing.Packer(np.zeros(7, dtype=bool), 64, packing.Costs(line=1_000, step=16), 0)
    pieces = [*packer.add(1, ids), *packer.add(2, ids[:10]), *packer.cut(last=True)]
    joined = np.concatenate([ids[s : s + n] for d, s, n, *_ in pieces if d == 1])
    assert (joined == ids).all()
    assert sum(n for _, _, n, *_ in pieces) == 5_010
