"""Compare registered queries with their SQL: python tests/compare.py SF [NAME...]"""

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def cell(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list):
        return tuple(map(cell, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as from read_parquet('{sf_dir}/{f}')")
    return con


def compare(spark, con, name, sf_dir):
    """'' if equal, else what differs."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = e.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    r = con.execute(sql)
    cols = [d[0] for d in r.description]
    want = rows_of(cols, r.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(cols)}"
    if got != want:
        g, w = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} rows / {len(want)}: only ours {sorted(g - w)[:3]}, only SQL {sorted(w - g)[:3]}"
    return "" if got else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    bad = 0
    for name in sys.argv[2:] or e.queries():
        t = time.time()
        try:
            said = compare(spark, con, name, sf_dir)
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:400]}"
        bad += bool(said)
        print(f"{'FAIL' if said else 'ok  '} {name} {time.time() - t:.1f}s {'' if name in e.oracle_sql() else '(rows only) '}{said[:700]}", flush=True)
    print("failures", bad)
