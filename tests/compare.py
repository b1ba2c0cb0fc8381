"""Side-by-side run of registered queries and their comparison SQL.

    python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None else str(list(v)) if hasattr(v, "__iter__") and not isinstance(v, str) else v)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = normal(a), normal(b)
    for c in a.columns:
        kinds = a[c].dtype.kind, b[c].dtype.kind
        if "f" in kinds and kinds[0] != kinds[1] and len(a):
            return f"{c}: type {a[c].dtype} vs {b[c].dtype}"
        if "f" in kinds:
            same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        else:
            same = (a[c].astype(str) == b[c].astype(str)) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"{c}: {int((~same).sum())} differ, e.g.\n{a.loc[i].to_dict()}\n{b.loc[i].to_dict()}"
    return "ok"


def main() -> int:
    import __spark_entry__ as entry
    from readweave.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(scratch=tempfile.mkdtemp(prefix="compare-"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    failed = 0
    for name in wanted:
        t0 = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name in oracle:
                result = compare(got, con.execute(oracle[name]).df())
            else:
                result = "rows only"
            failed += result not in ("ok", "rows only")
            print(f"{name:32s} {len(got):8d} rows {t1 - t0:6.2f}s spark {time.time() - t1:6.2f}s sql  {result}", flush=True)
        except Exception:
            failed += 1
            print(f"{name:32s} FAILED\n" + "\n".join(traceback.format_exc().splitlines()[-12:])[:1500], flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
