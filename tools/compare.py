"""Run registered queries against their SQL in DuckDB: tools/compare.py [--sf DIR] [key prefix...]"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time
from collections import Counter

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None if v is None else "NaN"
    if isinstance(v, float):
        return float(v) + 0.0
    return v


def compare(df, con, sql: str) -> tuple[str, int]:
    """('' or the mismatch, row count)"""
    names = sorted(df.columns)
    got = [tuple(_cell(r[n]) for n in names) for r in df.collect()]
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != names:
        return f"columns {names} vs {sorted(cols)}", len(got)
    order = [cols.index(n) for n in names]
    want = [tuple(_cell(r[i]) for i in order) for r in cur.fetchall()]
    types = {n: (type(a).__name__, type(b).__name__) for n, a, b in zip(names, got[0], want[0]) if
             a is not None and b is not None and type(a) is not type(b)} if got and want else {}
    if types:
        return f"types {types}", len(got)
    a, b = Counter(got), Counter(want)
    if a != b:
        return f"rows {len(got)} vs {len(want)}; only spark {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}", len(got)
    return "", len(got)


def main() -> int:
    from settlelens.plans import registered
    from settlelens.session import build_session

    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("keys", nargs="*")
    args = p.parse_args()
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for key, e in registered().items():
        if args.keys and not any(key.startswith(k) for k in args.keys):
            continue
        start = time.time()
        try:
            if e.oracle is None:
                n, msg = len(e.run(spark, args.sf).collect()), "no oracle"
            else:
                msg, n = compare(e.run(spark, args.sf), con, e.oracle)
                msg = msg or "ok"
        except Exception as exc:  # report and go on
            msg, n = f"ERROR {type(exc).__name__}: {str(exc)[:600]}", -1
        bad += msg not in ("ok", "no oracle")
        print(f"{key:36s} {n:7d} rows {time.time() - start:6.2f}s  {msg}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
