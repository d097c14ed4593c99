"""Run a query and its SQL twin and compare the rows exactly. ``python -m tests.compare SF_DIR [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


SPENT = {"spark": 0.0}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    start = time.time()
    df = run(spark, sf_dir)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    SPENT["spark"] = time.time() - start
    cur = con.execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} <> {sorted(want_names)}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if len(a) != len(b):
        return f"{len(a)} rows <> {len(b)}; only spark {list(set(a) - set(b))[:3]} only sql {list(set(b) - set(a))[:3]}"
    if [list(map(type, r)) for r in a[:1]] != [list(map(type, r)) for r in b[:1]]:
        return f"types {a[0]} <> {b[0]}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}" if bad else None


def main() -> int:
    import __spark_entry__ as entry
    from lensfold.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failures = duck(sf_dir), 0
    sql = entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, run, sql[name], sf_dir) if name in sql else (None if run(spark, sf_dir).count() >= 0 else "")
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s (spark {SPENT['spark']:.1f}s){'' if name in sql else ' (rows only)'} {problem or ''}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
