"""Run a registered query in Spark and its SQL in DuckDB and compare them:
row count, column names, and the sorted multiset of rows (floats compared
exactly; -0.0 equals 0.0).

    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from tandem.sources.bind import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    out = {"name": name, "spark_rows": len(s_rows), "duck_rows": len(d_rows),
           "spark_sec": round(t1 - t0, 2)}
    out["columns_match"] = sorted(s_cols) == sorted(d_cols)
    if not out["columns_match"]:
        out["columns"] = (s_cols, d_cols)
        out["values_match"] = False
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = {c: i for i, c in enumerate(d_cols)}
    s_norm = sorted((tuple(_norm(r[i]) for i in order) for r in s_rows), key=_key)
    d_norm = sorted((tuple(_norm(r[d_index[s_cols[i]]]) for i in order) for r in d_rows), key=_key)
    out["values_match"] = s_norm == d_norm
    if not out["values_match"]:
        diff = [(a, b) for a, b in zip(s_norm, d_norm) if a != b][:3]
        out["first_diffs"] = diff
    return out


def main(argv: list[str]) -> int:
    from tandem.plans.oracle import SQL
    from tandem.plans.queries import all_queries
    from tandem.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(SQL)
    spark = local_session(8, 8, checkpoint_dir=tempfile.mkdtemp())
    con = duck(sf_dir)
    queries = all_queries()
    bad = 0
    for name in names:
        try:
            r = compare(spark, con, name, queries[name], SQL[name], sf_dir)
        except Exception as exc:  # report and go on
            r = {"name": name, "error": repr(exc)[:400]}
        ok = r.get("values_match") and r.get("columns_match")
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
