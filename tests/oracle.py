"""Compare registered queries with their SQL on the same Parquet tables.

``python tests/oracle.py [sf_dir] [name-prefix ...]``
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 2**53 else round(v, 9)
    return v


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    t1 = time.time()
    cols, got = table([tuple(r) for r in rows], df.columns)
    if sql is None:
        return len(got) > 0, f"{name:28s} rows={len(got):6d} {t1 - t0:6.2f}s  (no SQL)"
    res = con.execute(sql)
    wcols, want = table(res.fetchall(), [d[0] for d in res.description])
    t2 = time.time()
    ok = cols == wcols and got == want
    msg = f"{name:28s} rows={len(got):6d} want={len(want):6d} {t1 - t0:6.2f}s sql {t2 - t1:5.2f}s {'ok' if ok else 'DIFF'}"
    if not ok:
        if cols != wcols:
            msg += f"\n   columns {cols}\n   wanted  {wcols}"
        else:
            a, b = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
            msg += f"\n   {cols}\n   got    {a}\n   wanted {b}"
    return ok, msg


if __name__ == "__main__":
    import __spark_entry__ as E
    from skyfence.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls, bad = E.oracle_sql(), []
    for name, fn in E.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        try:
            ok, msg = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as exc:  # report and go on with the next query
            ok, msg = False, f"{name:28s} FAILED {type(exc).__name__}: {str(exc)[:1500]}"
        print(msg, flush=True)
        if not ok:
            bad.append(name)
    print("not ok:", bad)
