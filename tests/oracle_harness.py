"""Run registered queries in Spark and their oracle SQL in DuckDB, compare results.

Mirrors the driver's check: row count, column names, and an order-insensitive
comparison of values.  Reports an exact match (values as they are) and a
tolerant one (doubles to 9 significant digits) separately.

    python -m tests.oracle_harness [sf_dir] [ID ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, tolerant: bool):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if tolerant:
            return float(f"{v:.9g}")
        return v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item(), tolerant)
        except Exception:
            pass
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, tolerant) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, tolerant)) for k, x in v.items()))
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(cols: list[str], rows: list[tuple], tolerant: bool):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], tolerant) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, qid: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    res = {"id": qid, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    res["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS {sorted(s_cols)} vs {sorted(d_cols)}"
        return res
    if len(s_rows) != len(d_rows):
        res["status"] = "ROWCOUNT"
        return res
    exact = rows_of(s_cols, s_rows, False) == rows_of(d_cols, d_rows, False)
    tol = exact or rows_of(s_cols, s_rows, True) == rows_of(d_cols, d_rows, True)
    res["status"] = "exact" if exact else ("tolerant" if tol else "VALUES")
    if not tol:
        a, b = rows_of(s_cols, s_rows, True), rows_of(d_cols, d_rows, True)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        res["example"] = str(diff)[:600]
    return res


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from riskframe.session import local_session

    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    ids = [a for a in argv if not a.startswith("/")]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for qid in (ids or list(qs)):
        try:
            r = compare(spark, con, qid, qs[qid], oracles.get(qid), sf_dir)
        except Exception as e:  # report and go on
            r = {"id": qid, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("exact", "tolerant", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"done: {len(ids or qs)} queries, {bad} not matching")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
