"""Run a registered query on Spark and its SQL on DuckDB, and compare the values."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """Return (ok, message, spark_rows)."""
    df = fn(spark, sf_dir)
    rows = [tuple(x) for x in df.collect()]
    if sql is None:
        return True, "rows only", len(rows)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    sc, st = table_of(df.columns, rows)
    dc, dt = table_of(names, cur.fetchall())
    if sc != dc:
        return False, f"columns {sc} vs {dc}", len(rows)
    if len(st) != len(dt):
        return False, f"rows {len(st)} vs {len(dt)}", len(rows)
    bad = [(a, b) for a, b in zip(st, dt) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, e.g.\n   spark {bad[0][0]}\n   sql   {bad[0][1]}", len(rows)
    return True, "equal", len(rows)


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from scorelab.session import local_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = local_session()
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    only_sql = "--sql" in wanted
    wanted = [w for w in wanted if w != "--sql"]
    for name, fn in queries.items():
        if only_sql and name not in oracle:
            continue
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            ok, msg, n = compare(spark, con, fn, oracle.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, msg, n = False, f"{type(exc).__name__}: {str(exc)[:1500]}", -1
            if "-v" in wanted:
                traceback.print_exc()
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {n:8d} rows {time.time() - start:6.2f}s  {msg if not ok or msg != 'equal' else ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
