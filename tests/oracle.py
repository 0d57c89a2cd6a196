"""Runs queries in Spark and their SQL in DuckDB and compares the rows, as `python -m tests.oracle [SF_DIR] [NAME...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings combined exports filter_results episodes window_scores event_labels cleaned_windows eval_windows doc_labels eval_items".split()


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (v if os.environ.get("EXACT") else float(f"{v:.9g}")) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "tolist"):
        return _plain(v.tolist())
    return v


def rows_of(names: list[str], rows) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, query, sql: str | None, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"ran, {len(got)} rows"
    ref = con.execute(sql)
    names = [c[0] for c in ref.description]
    want = rows_of(names, ref.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"DIFFERENT columns {sorted(df.columns)} {sorted(names)}"
    if len(got) != len(want):
        return f"DIFFERENT rows {len(got)} {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"DIFFERENT values in {len(bad)} of {len(got)}: {bad[0]}" if bad else f"same, {len(got)} rows"


def main(args: list[str]) -> None:
    import __spark_entry__ as e

    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = e.queries(), e.oracle_sql()
    for name in [q for q in queries if not args or q in args or any(a.endswith("*") and q.startswith(a[:-1]) for a in args)]:
        began = time.time()
        try:
            said = compare(spark, con, queries[name], sql.get(name), sf_dir)
        except Exception as x:  # noqa: BLE001
            said = f"FAILED {type(x).__name__}: {str(x)[:1500]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
