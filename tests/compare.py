"""Runs queries beside their SQL in DuckDB and reports differences. python -m tests.compare [sf_dir] [names...]"""

import datetime
import glob
import os
import sys

import duckdb


def views(d):
    con = duckdb.connect()
    con.execute("set memory_limit = '6GB'; set temp_directory = ''")
    for p in sorted(glob.glob(f"{d}/*.parquet")):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def cell(x):
    if isinstance(x, float):
        return f"{x + 0.0:.6f}".replace("-0.000000", "0.000000")
    if hasattr(x, "as_tuple"):
        return f"{float(x):.6f}".replace("-0.000000", "0.000000")
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def differences(spark, con, f, sql, d):
    df = f(spark, d)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    columns = sorted(df.columns)
    have = sorted([cell(x) for x in r] for r in df.select(*columns).collect())
    want = sorted([cell(x) for x in r] for r in rel.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    if len(have) != len(want):
        return f"{len(have)} rows, SQL {len(want)}"
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    return f"{len(bad)} of {len(have)} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sql, names = views(d), entry.oracle_sql(), sys.argv[2:]
    for name, f in entry.queries().items():
        if names and not any(name.startswith(n) for n in names) or not names and (name[:2] == "op" or name == "pipeline"):
            continue
        t = time.time()
        try:
            found = differences(spark, con, f, sql[name], d) if name in sql else f"no SQL, {f(spark, d).count()} rows"
        except Exception as e:  # noqa: BLE001
            found = "ERROR " + str(e)[:300].replace("\n", " ")
        print(f"{name}: {found or 'same'} ({time.time() - t:.1f} s)", flush=True)
