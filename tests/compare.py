"""Run queries on Spark and their SQL on DuckDB, and compare the rows without order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, (int, float)) or type(x).__module__ in ("numpy", "decimal"):
        return f"{float(x) + 0.0:.9g}"
    return str(x).removesuffix(" 00:00:00").removesuffix("+00:00")


def difference(spark, con, run, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    got = run(spark, sf_dir)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    keys = sorted(names)
    want = sorted(tuple(plain(r[names.index(k)]) for k in keys) for r in rel.fetchall())
    have = sorted(tuple(plain(r[k]) for k in keys) for r in got.collect())
    if len(want) != len(have):
        return f"{len(have)} and {len(want)} rows; first only here {sorted(set(have) - set(want))[:3]}, first only in SQL {sorted(set(want) - set(have))[:3]}"
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    return f"{len(bad)} of {len(have)} rows differ, for example {bad[0]}" if bad else ""
