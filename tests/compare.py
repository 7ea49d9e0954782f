"""Run every named query against its SQL; usable as a script and from tests.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return float(f"{x:.12g}") + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def order_key(row):
    return tuple((v is None, str(type(v).__name__ if not isinstance(v, (int, float)) else "n"), str(v)) for v in row)


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(cells, key=order_key)


def spark_result(df):
    return table_rows(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql):
    cur = con.execute(sql)
    return table_rows([d[0] for d in cur.description], cur.fetchall())


def differences(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}: {got[1][:2]} / {want[1][:2]}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(want[1])} rows differ, first {bad[0]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tallymart.session import build_session

    spark = build_session(
        "compare", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql, failed = oracle_sql(), []
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = spark_result(run(spark, sf_dir))
            took = time.time() - start
            problem = differences(got, sql_result(con, sql[name])) if name in sql else None
        except Exception as e:  # report and go on with the next query
            got, took, problem = ([], []), time.time() - start, f"{type(e).__name__}: {str(e)[:600]}"
        state = "FAIL" if problem else ("ok" if name in sql else "ok (no SQL)")
        print(f"{name:34s} {len(got[1]):7d} rows {took:6.2f}s {state} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(min(main(folder, sys.argv[2:]), 100))
