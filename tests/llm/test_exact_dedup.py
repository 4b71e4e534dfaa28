import hashlib
import re

from markbook.llm import exact_dedup
from tests.llm.frames import frame, odd_rows, prose


def brute(rows):
    sums = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t in rows]
    out = []
    for (i, _), s in zip(rows, sums):
        group = [j for (j, _), other in zip(rows, sums) if other == s]
        keep = min((j for j in group if j is not None), default=None)
        if len(group) == 1:
            keep = i
        out.append((i, keep, len(group), i == keep, s))
    return sorted(out, key=repr)


def test_groups_match_brute_force(spark):
    hot = prose(1, 40)
    rows = [(i, hot if i % 3 == 0 else prose(i, 5 + i % 30)) for i in range(90)]
    rows += [(200 + i, prose(i, 5 + i % 30).replace(" ", " \n\t")) for i in range(10)]
    # The same length and prefix, another end; the same length only.
    rows += [(300, "p" * 80 + "a"), (301, "p" * 80 + "b"), (302, "q" * 81), (303, " lead"), (304, "lead")]
    rows += odd_rows()
    got = exact_dedup.exact_duplicates(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    got = exact_dedup.exact_duplicates(frame(spark, []))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got.count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.exact_duplicates(frame(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
