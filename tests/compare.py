"""Runs registered queries against their SQL in DuckDB: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ in ("bool_", "bool"):
        return bool(value)
    if isinstance(value, (int, float)) or type(value).__name__ in ("Decimal", "float64", "int64", "int32"):
        return round(float(value), 6)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def check(con, df, sql: str) -> str | None:
    """None when rows agree, else what differs."""
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, {sorted(names)}: {bad[0]}"
    return None if got else "EMPTY"


def main() -> None:
    import __spark_entry__ as entry
    from flowlens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session("8")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sql:
                result = check(con, fn(spark, sf_dir), sql[name])
            else:
                result = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001 - a report of every query is wanted
            result = f"ERROR {str(error)[:600]}"
        failed += result is not None and not result.startswith("rows only")
        if result is not None or names:
            print(f"{name} {time.time() - start:.1f}s {result or 'ok'}", flush=True)
    print("queries", len(entry.queries()), "sql", len(sql), "failed", failed, "sql without query", set(sql) - set(entry.queries()))


if __name__ == "__main__":
    main()
