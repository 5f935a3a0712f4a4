"""Run queries next to their SQL and compare every value: ``python -m tests.oracle_check [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("arcloom")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    return names, types, cur.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, fn, sql: str | None):
    """``(message, rows)``; an empty message means that all is equal."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return "", len(got)
    names, types, want = oracle_rows(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    a, b = normal(df.columns, got), normal(names, want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"{len(a)} rows vs {len(b)}; spark only {only_a}; sql only {only_b}", len(got)
    kinds = dict(zip(names, types))
    wide = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = [f"{n}: {t} vs {kinds[n]}" for n, t in df.dtypes if wide.get(t) != kinds[n]]
    return ("types " + ", ".join(off)) if off else "", len(got)


def main(argv):
    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(entry.queries())
    spark, bad = session(), 0
    for name in names:
        t = time.time()
        try:
            message, rows = compare(spark, f"/root/testdata/sf{sf}", entry.queries()[name], entry.oracle_sql().get(name))
        except Exception as e:  # noqa: BLE001
            message, rows = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += bool(message)
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if message else 'ok'} {name} [{kind}] rows={rows} {time.time() - t:.1f}s {message}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
