"""Runs registered queries beside their SQL and compares rows as sets of values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def close(a, b, tol):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None or isinstance(a, str) or isinstance(b, str):
            return a == b
        return math.isclose(a, b, rel_tol=tol, abs_tol=tol)
    return a == b and type(a) is type(b)


def compare(spark_cols, spark_rows, sql_cols, sql_rows, tol=0.0) -> str | None:
    """None when equal, else the first difference; ``tol`` 0 means bit-equal floats."""
    ca, ra = normal(spark_cols, spark_rows)
    cb, rb = normal(sql_cols, sql_rows)
    if ca != cb:
        return f"columns {ca} vs {cb}"
    if len(ra) != len(rb):
        return f"rows {len(ra)} vs {len(rb)}"
    for x, y in zip(ra, rb):
        for name, p, q in zip(ca, x, y):
            same = (p == q and isinstance(p, float) == isinstance(q, float)) if tol == 0 else close(p, q, tol)
            if not same:
                return f"{name}: {p!r} vs {q!r} in {x} vs {y}"
    return None


def check(spark, con, sf_dir, name, fn, sql, tol=0.0):
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(rows), None
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return len(rows), compare(df.columns, rows, columns, result.fetchall(), tol)


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tidemark.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("oracle-check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            n, problem = check(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as error:  # report and go on with the next query
            n, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        label = "ok" if problem is None else "BAD"
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{label:4} {kind:4} {name:34} rows={n:<7} {time.time() - start:6.2f}s {'' if problem is None else problem[:700]}", flush=True)
    print(f"bad={bad} of {len(queries)}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
