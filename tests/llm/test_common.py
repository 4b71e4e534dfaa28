import pytest

from markbook import session
from markbook.llm import common
from tests.llm.frames import frame, result


@pytest.mark.parametrize("most", [0, 10])
def test_ids_are_matched_broadcast_or_not(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    rows = frame(spark, [(1, "a"), (2, "b"), (2, "b"), (None, "c")], extra=False).select("doc_id", "text")
    ids = spark.createDataFrame([(2, 7), (2, 8), (9, 9), (None, 1)], "doc_id long, text long")
    assert result(common.by_ids(rows, ids, "left_semi")) == [(2, "b"), (2, "b")]
    assert result(common.by_ids(rows, ids, "left_anti")) == [(1, "a"), (None, "c")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salts_change_no_result(spark, how):
    rows = spark.range(500).selectExpr("id", "if(id % 3 = 0, 0, id % 20) AS k")
    keyed = spark.range(12).selectExpr("id AS k", "id * 2 AS v")
    assert result(common.salted_join(rows, keyed, ["k"], how).select("id", "k")) == result(
        rows.join(keyed, ["k"], how).select("id", "k")
    )


def test_a_staged_table_keeps_rows_and_types(spark):
    rows = frame(spark, [(1, "a"), (None, None)])
    staged = common.stage(rows)
    assert staged.dtypes == rows.dtypes and result(staged) == result(rows)


def test_sessions_of_others_get_small_batches(spark):
    other = spark.newSession()
    other.conf.set(session.BATCH_ROWS, "10000")
    session.attach(other)
    assert other.conf.get(session.BATCH_ROWS) == session.SETTINGS[session.BATCH_ROWS]
    sizes = other.range(3_000, numPartitions=1).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "id long")
    assert sizes.count() == 2 and common.stage(sizes).count() == 6
    assert other.conf.get(session.BATCH_ROWS) == session.SETTINGS[session.BATCH_ROWS]
    other.conf.set(session.BATCH_ROWS, "100")
    assert session.attach(other).conf.get(session.BATCH_ROWS) == "100" and common.stage(sizes).count() == 30
