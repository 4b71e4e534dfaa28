"""Compare registered queries with their SQL twins: ``python -m checks.run [sf] [names...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from checks import registry
from checks.all import load
from markbook.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(values_of(r[i]) for i in order) for r in values), key=lambda r: tuple(map(str, r))
    )


def values_of(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v


def main(sf: str, names: list[str]) -> int:
    load()
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    path = f"/root/testdata/{sf}"
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet')")
    bad = 0
    for name in names or list(registry.QUERIES):
        start = time.time()
        try:
            df = registry.QUERIES[name](spark, path)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in registry.TWINS:
                print(f"rows  {name}: {len(got)} rows, {took:.2f}s", flush=True)
                continue
            start = time.time()
            cur = db.execute(registry.TWINS[name])
            want_names = [c[0] for c in cur.description]
            want_types = [str(c[1]) for c in cur.description]
            want = cur.fetchall()
            sql_took = time.time() - start
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            continue
        a, b = rows(df.columns, got), rows(want_names, want)
        same = sorted(df.columns) == sorted(want_names) and a == b
        bad += not same
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(a)} rows, spark {took:.2f}s, sql {sql_took:.2f}s", flush=True)
        if not same:
            print("   ", sorted(df.columns), sorted(want_names), len(a), len(b))
            shown = 0
            for x, y in zip(a, b):
                if x != y and shown < 4:
                    shown += 1
                    print("    spark", str(x)[:400], "\n    sql  ", str(y)[:400])
        kinds = sorted(zip(want_names, want_types))
        odd = [k for k in kinds if "INT128" in k[1].upper() or "HUGE" in k[1].upper() or "DECIMAL" in k[1].upper()]
        if odd:
            print("    wide types:", odd)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "sf0.001", sys.argv[2:]) else 0)
