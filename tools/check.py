"""Run registered queries and compare with DuckDB: python tools/check.py [names or module letters] [--sf 0.01]."""

import argparse
import importlib
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return [norm(x) for x in v]
    if hasattr(v, "asDict"):
        return {k: norm(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: norm(x) for k, x in v.items()}
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--slow", type=float, default=0)
    args = ap.parse_args()
    import duckdb

    from dosewise.session import get_session
    entry = importlib.import_module("__spark_entry__")
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    want = args.names or list(queries)
    bad = []
    for name in [q for q in queries if q in want or any(q.startswith(w[:-1]) for w in want if w.endswith("*"))]:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = df.collect()
        except Exception as e:
            print(f"FAIL {name}: spark {type(e).__name__}: {str(e)[:900]}", flush=True)
            bad.append(name)
            continue
        t1 = time.time()
        if name not in oracle:
            print(f"rows {name}: {len(got)} rows {t1 - t0:.2f}s {got[:1]}"[:300], flush=True)
            continue
        try:
            cur = con.execute(oracle[name])
            cols = [d[0] for d in cur.description]
            exp = cur.fetchall()
        except Exception as e:
            print(f"FAIL {name}: duckdb {type(e).__name__}: {str(e)[:900]}", flush=True)
            bad.append(name)
            continue
        t2 = time.time()
        if sorted(cols) != sorted(df.columns):
            print(f"FAIL {name}: columns {sorted(df.columns)} against {sorted(cols)}", flush=True)
            bad.append(name)
            continue
        a, b = rows_of(df.columns, got), rows_of(cols, exp)
        nulls = [c for i, c in enumerate(sorted(df.columns)) if a and all(r[i] is None for r in a)]
        if a != b:
            sa, sb = [r for r in a if r not in b][:3], [r for r in b if r not in a][:3]
            print(f"FAIL {name}: {len(a)} against {len(b)} rows\n  cols {sorted(df.columns)}\n  spark {sa}\n  duck  {sb}"[:1500], flush=True)
            bad.append(name)
        elif t1 - t0 >= args.slow:
            print(f"ok {name}: {len(a)} rows, spark {t1 - t0:.2f}s, duck {t2 - t1:.2f}s{' ALLNULL ' + str(nulls) if nulls else ''}{' EMPTY' if not a else ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
