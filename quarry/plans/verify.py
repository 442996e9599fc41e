"""Side-by-side check of registered queries against their DuckDB oracle.

Mirrors the driver's gate: row count, column names, and an order-insensitive hash
of the values (columns sorted by name). Usage::

    python -m quarry.plans.verify /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256()
    for line in lines:
        h.update(line.encode("utf-8", "surrogatepass"))
        h.update(b"\n")
    return h.hexdigest()


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    from .catalog import ORACLES, QUERIES

    con = duck_connection(sf_dir)
    out = {}
    for name in names or list(QUERIES):
        rec = {"name": name}
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
            rec["spark_rows"] = len(s_rows)
            rec["spark_sec"] = round(time.time() - t, 2)
        except Exception as e:  # pragma: no cover - reported
            rec["error"] = f"spark: {type(e).__name__}: {str(e)[:400]}"
            out[name] = rec
            if verbose:
                print(rec, flush=True)
            continue
        sql = ORACLES.get(name)
        if sql is None:
            rec["oracle"] = "none"
        else:
            try:
                res = con.execute(sql)
                d_cols = [c[0] for c in res.description]
                d_rows = res.fetchall()
                rec["duck_rows"] = len(d_rows)
                rec["cols_match"] = sorted(s_cols) == sorted(d_cols)
                if not rec["cols_match"]:
                    rec["cols"] = (sorted(set(s_cols) - set(d_cols)), sorted(set(d_cols) - set(s_cols)))
                rec["hash_match"] = rec["cols_match"] and digest(s_cols, s_rows) == digest(d_cols, d_rows)
                if rec["cols_match"] and not rec["hash_match"]:
                    order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
                    order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
                    ss = sorted("|".join(_norm(r[i]) for i in order_s) for r in s_rows)
                    dd = sorted("|".join(_norm(r[i]) for i in order_d) for r in d_rows)
                    only_s = sorted(set(ss) - set(dd))[:3]
                    only_d = sorted(set(dd) - set(ss))[:3]
                    rec["diff"] = {"cols": [s_cols[i] for i in order_s], "spark_only": only_s,
                                   "duck_only": only_d}
            except Exception as e:  # pragma: no cover - reported
                rec["error"] = f"duck: {type(e).__name__}: {str(e)[:400]}"
        out[name] = rec
        if verbose:
            print(rec, flush=True)
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from ..session import get_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or None
    spark = get_session()
    res = compare(spark, sf_dir, names)
    bad = [n for n, r in res.items() if r.get("error") or r.get("hash_match") is False
           or r.get("spark_rows") != r.get("duck_rows", r.get("spark_rows"))]
    print("FAILED:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
