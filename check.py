"""Run registered queries against their SQL on one scale factor and report every difference.

usage: python check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from loomcast.plans import ORACLES, QUERIES
from loomcast.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        out.append(tuple(
            "nan" if isinstance(row[i], float) and math.isnan(row[i]) else row[i] for i in order))
    return sorted(columns), sorted(out, key=repr)


def oracle_rows(con, sql):
    cur = con.execute(sql)
    return _rows([d[0] for d in cur.description], cur.fetchall())


def spark_rows(df):
    return _rows(df.columns, [tuple(x) for x in df.collect()])


def connect(root):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def compare(spark, con, root, name):
    got = spark_rows(QUERIES[name](spark, root))
    if name not in ORACLES:
        return ("rows-only" if got[1] else "EMPTY"), len(got[1]), ""
    want = oracle_rows(con, ORACLES[name])
    if got[0] != want[0]:
        return "COLUMNS", len(got[1]), f"{got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return "COUNT", len(got[1]), f"{len(got[1])} vs {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b or [type(v) for v in a] != [type(v) for v in b]]
    if bad:
        return "VALUES", len(got[1]), f"{len(bad)} differ, e.g. {bad[0]}"
    return "ok", len(got[1]), ""


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("prefix", nargs="*")
    args = ap.parse_args()
    root = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(), connect(root)
    failed = 0
    for name in QUERIES:
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        start = time.time()
        try:
            state, rows, note = compare(spark, con, root, name)
        except Exception as e:  # report and go on
            state, rows, note = "ERROR", 0, f"{type(e).__name__}: {str(e)[:700]}"
        failed += state not in ("ok", "rows-only")
        print(f"{state:9} {name:40} rows={rows:<7} {time.time() - start:5.1f}s {note}", flush=True)
    print(f"failed: {failed}")


if __name__ == "__main__":
    main()
