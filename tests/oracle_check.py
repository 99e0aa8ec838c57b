"""Run registered queries next to their SQL twins and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """Problem text, or None if both give the same rows; with both run times."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - start
    if sql is None:
        return (None if got else "no rows"), len(got), spark_s, 0.0
    start = time.time()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    sql_s = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got), spark_s, sql_s
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return (None if got else "no rows"), len(got), spark_s, sql_s
    left, right = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    return f"{len(a)} vs {len(b)} rows; {sorted(names)}\n   spark {left}\n   sql   {right}", len(got), spark_s, sql_s


def main():
    from __spark_entry__ import oracle_sql, queries
    from auditloom.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, bad, total = oracle_sql(), [], 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        total += 1
        try:
            problem, n, a, b = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            problem, n, a, b = f"{type(e).__name__}: {str(e)[:600]}", 0, 0, 0
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name:36s} rows={n:6d} spark={a:5.1f}s sql={b:5.1f}s {'' if name in sqls else 'no sql'}", flush=True)
        if problem:
            bad.append(name)
            print("   ", problem, flush=True)
    print(f"{total - len(bad)}/{total} good; bad: {bad}")


if __name__ == "__main__":
    main()
