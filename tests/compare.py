"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

Usage: python tests/compare.py SF_DIR [name-or-module-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype == object:
            pdf[c] = pdf[c].map(lambda v: None if v is None or v is pd.NA else str(v))
    return pdf.sort_values(list(pdf.columns), na_position="last").reset_index(drop=True)


def differences(a: pd.DataFrame, b: pd.DataFrame, tol: float = 2e-6) -> str | None:
    """None when equal, else a short description."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = canonical(a), canonical(b)
    notes = []
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind in "fiub" and y.dtype.kind in "fiub":
            x, y = x.to_numpy(float), y.to_numpy(float)
            ok = (np.isnan(x) & np.isnan(y)) | (x == y)
            near = ok | (np.abs(x - y) <= tol * np.maximum(1, np.abs(x)))
            if not near.all():
                i = int(np.argmin(near))
                notes.append(f"{c}: {int((~near).sum())} differ, row {i}: {x[i]} vs {y[i]}")
            elif not ok.all():
                notes.append(f"~{c}: {int((~ok).sum())} last-digit")
        else:
            ok = (x.isna() & y.isna()) | (x.astype(str) == y.astype(str))
            if not ok.all():
                i = int(np.argmin(ok.to_numpy()))
                notes.append(f"{c}: {int((~ok).sum())} differ, row {i}: {x[i]} vs {y[i]}")
    return "; ".join(notes) or None


def main(argv):
    from barloom.plans import load_all
    from barloom.session import local_session

    sf_dir, wanted = argv[0], argv[1:]
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name, q in load_all().items():
        mod = q.run.__module__
        if os.environ.get("SKIP") and mod.endswith(tuple(os.environ["SKIP"].split(","))):
            continue
        if wanted and not any(name == w or mod.endswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            got = q.run(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark {str(e)[:600]}", flush=True)
            continue
        ts = time.time() - t
        if q.sql is None:
            print(f"rows-only {name}: {len(got)} rows {ts:.1f}s", flush=True)
            continue
        t = time.time()
        try:
            cur = con.execute(q.sql)
            want = cur.fetchdf()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: sql {str(e)[:600]}", flush=True)
            continue
        d = differences(got, want)
        nulls = {c: int(got[c].isna().sum()) for c in got.columns if got[c].isna().any()}
        bad += bool(d) and not d.startswith("~")
        print(f"{'ok  ' if not d else 'DIFF'} {name}: {len(got)} rows {ts:.1f}s duck {time.time()-t:.1f}s {d or ''} nulls={nulls}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
