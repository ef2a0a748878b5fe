"""Runs queries beside their SQL: python tests/verify.py [sf] [name...]"""

import glob
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        p = f if os.path.isfile(f) else f + "/*.parquet"
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{p}'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, list | tuple):
        return str([canon(x) for x in v])
    return str(v)


def compare(spark, con, name, fn, sql, sf_dir):
    began = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(canon(r[c]) for c in cols) for r in df.collect())
    took = time.time() - began
    if sql is None:
        return f"rows {sum(got.values())} (no SQL) {took:.1f}s"
    rel = con.sql(sql)
    order = [rel.columns.index(c) for c in cols] if sorted(rel.columns) == cols else None
    if order is None:
        return f"COLUMNS {cols} {sorted(rel.columns)}"
    want = Counter(tuple(canon(r[i]) for i in order) for r in rel.fetchall())
    if got == want:
        return f"ok {sum(got.values())} rows {took:.1f}s"
    return f"DIFFERENT {sum(got.values())} {sum(want.values())} spark-only {list((got - want).items())[:3]} sql-only {list((want - got).items())[:3]}"


if __name__ == "__main__":
    from jointmill.session import build

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    d = f"/root/testdata/{sf}"
    spark = build("verify", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(d), entry.oracle_sql()
    bad = 0
    for k, f in entry.queries().items():
        if len(sys.argv) > 2 and k not in sys.argv[2:]:
            continue
        try:
            said = compare(spark, con, k, f, sqls.get(k), d)
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:1500]}"
        bad += not said.startswith(("ok", "rows"))
        print(k, said, flush=True)
    print("bad", bad)
