"""Run queries against their SQL in DuckDB: python tests/parity.py [sf_dir] [names...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _norm(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[:-8]
        src = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"rows {len(got[1])} and {len(want[1])}; only Spark {list(a - b)[:3]}; only SQL {list(b - a)[:3]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e
    from scriptoria.session import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            if name in o:
                said = compare(spark, con, sf, name, q[name], o[name]) or "ok"
            else:
                said = f"no SQL, {q[name](spark, sf).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        bad += not (said == "ok" or said.startswith("no SQL"))
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
    print("bad:", bad)
    sys.exit(bad > 0)
