"""python tests/oracle.py SF_DIR [NAME...]: queries against their SQL, as multisets of rows."""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(spark, name, f, sql, sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(sf_dir).iterdir():
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.sql(f"create view {p.stem} as select * from read_parquet('{src}')")
    df = f(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(norm(v) for v in r) for r in df.select(*names).collect())
    if sql is None:
        return None, sum(got.values()), None
    rel = con.sql(sql)
    assert sorted(rel.columns) == names, (names, sorted(rel.columns))
    want = Counter(tuple(norm(v) for v in r) for r in rel.select(*[f'"{n}"' for n in names]).fetchall())
    more, less = got - want, want - got
    return not more and not less, sum(got.values()), (list(more.items())[:3], list(less.items())[:3])


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    qs, sql = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or qs:
        t = time.time()
        try:
            ok, rows, diff = compare(spark, n, qs[n], sql.get(n), sys.argv[1])
            print(f"{'no SQL' if ok is None else 'ok' if ok else 'DIFFERS'} {n} rows={rows} {time.time() - t:.1f}s", "" if ok is not False else diff, flush=True)
        except Exception as x:
            print("ERROR", n, str(x)[:1500], flush=True)
