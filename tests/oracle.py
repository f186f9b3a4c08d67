"""Run catalog cases on Spark and their SQL on DuckDB and compare the rows.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.environ.get("TESTDATA", "/root/testdata")


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(v)) for v in row)


def _clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def compare(case, spark, con, sf_dir: str) -> tuple[str, int, str]:
    """('ok' | 'rows-only' | 'DIFF', row count, detail)"""
    df = case.spark(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(_clean(r[c]) for c in names) for r in df.collect()]
    sql = case.oracle()
    if sql is None:
        return "rows-only", len(got), ""
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != names:
        return "DIFF", len(got), f"columns {sorted(cols)} vs {names}"
    order = [cols.index(c) for c in names]
    want = [tuple(_clean(r[i]) for i in order) for r in cur.fetchall()]
    got.sort(key=_key)
    want.sort(key=_key)
    if got == want:
        return "ok", len(got), ""
    only_got = set(got) - set(want)
    only_want = set(want) - set(got)
    detail = f"{len(got)} vs {len(want)} rows, {len(only_got)}/{len(only_want)} differ; {names} spark {sorted(only_got, key=_key)[:2]} sql {sorted(only_want, key=_key)[:2]}"
    return "DIFF", len(got), detail


def main(argv):
    import argparse

    from pickwright.catalog import load
    from pickwright.session import build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    args = ap.parse_args(argv)
    spark = build_session("oracle", master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{ROOT}/sf{args.sf}"
    con = duck(sf_dir)
    bad = 0
    for name, c in load().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        t = time.time()
        try:
            status, n, detail = compare(c, spark, con, sf_dir)
        except Exception as e:  # noqa: BLE001
            status, n, detail = "ERROR", 0, f"{type(e).__name__}: {str(e)[:700]}"
        bad += status in ("DIFF", "ERROR")
        print(f"{status:9} {name:32} {n:7} rows {time.time() - t:6.2f}s {detail}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
