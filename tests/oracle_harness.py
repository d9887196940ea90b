"""Run named Spark queries and their DuckDB oracle side by side and compare.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:10] if len(str(v)) >= 10 and str(v)[10:].strip("0: ") == "" else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return tuple(_norm(x) for x in v.tolist())
        if isinstance(v, np.generic):
            return _norm(v.item())
    except ImportError:
        pass
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in df.to_dict("records")]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_schema = [(f.name, f.dataType.simpleString()) for f in sdf.schema.fields]
    s = sdf.toPandas()
    ts = time.time() - t0
    res = {"name": name, "spark_rows": len(s), "spark_sec": round(ts, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    t0 = time.time()
    rel = con.sql(sql)
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    d = rel.df()
    res["duck_sec"] = round(time.time() - t0, 2)
    res["duck_rows"] = len(d)
    if sorted(s.columns) != sorted(d.columns):
        res["status"] = f"COLUMNS spark={sorted(s.columns)} duck={sorted(d.columns)}"
        return res
    type_map = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "date": "DATE", "boolean": "BOOLEAN"}
    bad_types = [(c, t, d_types.get(c)) for c, t in s_schema
                 if type_map.get(t) and type_map[t] != d_types.get(c)]
    if len(s) != len(d):
        res["status"] = "ROWCOUNT"
        return res
    rs, rd = rows_of(s), rows_of(d)
    diffs = [(a, b) for a, b in zip(rs, rd) if a != b]
    if diffs:
        res["status"] = f"VALUES {len(diffs)} differ; first spark={diffs[0][0]} duck={diffs[0][1]}"
    else:
        res["status"] = "ok" if not bad_types else f"ok (types {bad_types})"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    only = [a for a in argv[1:] if not os.path.isdir(a)]
    from tarmac.session import get_session
    import __spark_entry__ as entry
    spark = get_session("local[8]", shuffle_partitions=8)
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (only or list(qs)):
        try:
            r = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if not str(r["status"]).startswith(("ok", "rows-only")):
            bad += 1
        print(r, flush=True)
    print(f"{bad} failing of {len(only or qs)}")


if __name__ == "__main__":
    main(sys.argv)
