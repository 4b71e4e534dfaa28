import zlib

import pytest

from markbook.llm import quality
from tests.llm.frames import ODD, frame, odd_rows, prose


def test_given_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.score_quality(docs, labels)
    assert found.count() == docs.count()
    held = found.where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    for r in found.collect():
        assert 0.0 <= r["score"] <= 1.0
        assert r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_statistics_match_python(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, "A a a. B!! 12 | x\n", prose(1, 50)])]
    for r in quality.statistics(frame(spark, rows)).collect():
        text = dict(rows)[r["doc_id"]] or ""
        words = [w.decode() for w in text.encode().split()]
        assert r["distinct"] == pytest.approx(len(set(words)) / len(words) if words else 0)
        assert r["again"] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / len(words) if words else 0)
        assert r["digits"] == pytest.approx(sum(c in "0123456789" for c in text) / len(text) if text else 0)


@pytest.mark.parametrize("given", [[], [(1, 1), (2, 1)], [(3, 0)], [(1, None), (None, 1), (2, 5)]])
def test_few_labels(spark, given):
    rows = [(1, "good text"), (2, "more text"), (3, "###"), *odd_rows()]
    labels = spark.createDataFrame([(d, q, 0) for d, q in given], "doc_id long, quality int, toxic int")
    found = quality.score_quality(frame(spark, rows), labels).collect()
    assert len(found) == len(rows)
    assert all(0.0 <= r["score"] <= 1.0 for r in found)


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.score_quality(frame(spark, []), labels).count() == 0


def test_paths_of_a_printed_tree():
    tree = """DecisionTreeClassificationModel: depth=2, numNodes=5
  If (feature 1 <= 0.5)
   If (feature 0 <= 2.0)
    Predict: 0.0
   Else (feature 0 > 2.0)
    Predict: 1.0
  Else (feature 1 > 0.5)
   Predict: 1.0
"""
    low, high = ("b", True, 0.5), ("b", False, 0.5)
    assert quality.paths(tree, ["a", "b"]) == {
        (low,),
        tuple(sorted([low, ("a", True, 2.0)])),
        tuple(sorted([low, ("a", False, 2.0)])),
        (high,),
    }
