"""Compare registered queries with their SQL on one data folder.

Usage: ``python -m rolemill.plans.check <folder> [name prefix …]``
"""

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted(zip(*[[_cell(v) for v in frame[n].astype(object)] for n in names])) \
        if len(frame) else []


def compare(spark, con, folder: str, fn, sql: str) -> str:
    """Empty when equal, else what differs."""
    ours = fn(spark, folder).toPandas()
    theirs = con.sql(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    a, b = rows_of(ours), rows_of(theirs)
    if a == b:
        return ""
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    return (f"rows {len(a)} vs {len(b)}; only ours {len(only_a)} {sorted(only_a)[:3]}; "
            f"only sql {len(only_b)} {sorted(only_b)[:3]}")


def main(folder: str, prefixes: list[str]) -> int:
    from rolemill.plans import catalog
    from rolemill.session import local_session

    spark = local_session(os.environ.get("CHECK_CPUS", "8"), memory="12g")
    con, bad = connect(folder), 0
    for name, fn in catalog.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in catalog.SQL:
                problem = compare(spark, con, folder, fn, catalog.SQL[name])
                n = ""
            else:
                problem, n = "", f"rows only: {fn(spark, folder).count()}"
        except Exception as e:
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s "
              f"{n}{problem[:1500]}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
