"""The pipeline against one of brute force; every query on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from checks.run import TABLES
from checks.run import rows as sorted_rows
from markbook.llm import queries
from tests.llm import test_decontaminate, test_exact_dedup, test_near_dedup, test_packing
from tests.llm.frames import edited, frame, odd_rows, prose

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark, tmp_path):
    item = prose(500, 40)
    rows = [(i, prose(i, 40 + i)) for i in range(40)]
    rows += [(100 + i, prose(i, 40 + i).replace(" ", "  ")) for i in range(5)]
    rows += [(200 + i, edited(prose(i, 40 + i), i, 1)) for i in range(5, 10)]
    rows += [(300 + i, prose(600 + i, 100) + " " + item) for i in range(4)]
    rows += [r for r in odd_rows() if r[0] is not None and r[0] != 10_000]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, item), (2, "never there at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    left = [r for r, keep in zip(sorted(left, key=repr), [x[3] for x in by_id(test_exact_dedup.brute(left))]) if keep]
    kept = {x[0] for x in test_near_dedup.brute(left) if x[3]}
    left = [r for r in left if r[0] in kept]
    clean = {x[0] for x in test_decontaminate.brute(left, items) if not x[5]}
    left = [r for r in left if r[0] in clean]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == {r[0] for r in left}
    test_packing.checked(pieces, left)


def by_id(found):
    return sorted(found, key=repr)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(30)
    for _, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, FOLDER).dtypes == docs.dtypes


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"pipeline"}))
def test_query(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in found.collect()]
    assert got
    if name in queries.TWINS:
        db = duckdb.connect()
        for table in TABLES:
            db.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
        cursor = db.execute(queries.TWINS[name])
        names = [c[0] for c in cursor.description]
        assert sorted(found.columns) == sorted(names)
        assert sorted_rows(found.columns, got) == sorted_rows(names, cursor.fetchall())
