import re

from markbook.llm import decontaminate
from tests.llm.frames import frame, odd_rows, prose


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n and name is not None else ():
            windows.setdefault((n, tuple(w[k : k + n])), set()).add(str(name))
    sizes = {n for n, _ in windows}
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                names = windows.get((n, tuple(w[k : k + n])))
                if names:
                    hit.update(range(k, k + n))
                    found |= names
        out.append((doc_id, len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def setting(spark):
    items = [(i, prose(i, 30, 20)) for i in range(8)]
    items += [(20, "Alone"), (21, "two Words"), (22, "w1 w2 w3"), (23, None), (24, " .. "), (25, prose(1, 30, 20))]
    items += [(26, prose(2, 30, 20)[:40]), (27, "Öl é 7"), (None, prose(3, 30, 20)), (20, "Alone")]
    rows = [(i, prose(100 + i, 60, 20)) for i in range(30)]
    rows += [(50 + i, prose(200 + i, 20) + "... " + prose(i, 30, 20).upper()[: 90 + i] + "!") for i in range(20)]
    rows += [(90, "öl É 7, alone; TWO-words w1/w2.w3"), (91, "Öl é 7 " * 3), (92, prose(1, 30, 20))]
    rows += odd_rows()
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return rows, items, bench


def plain(found):
    return sorted(
        ((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in found.collect()),
        key=repr,
    )


def test_windows_match_brute_force(spark):
    rows, items, bench = setting(spark)
    docs = frame(spark, rows)
    want = brute(rows, items)
    assert plain(decontaminate.find_contamination(docs, bench)) == want


def test_several_passes_give_the_same(spark):
    rows, items, bench = setting(spark)
    assert plain(decontaminate.find_contamination(frame(spark, rows), bench, shard_bytes=400)) == brute(rows, items)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.find_contamination(frame(spark, [(1, "a b"), (2, None)]), bench)
    assert plain(got) == [(1, 2, 0, 0, [], False), (2, 0, 0, 0, [], False)]
    assert decontaminate.find_contamination(frame(spark, []), bench).count() == 0
