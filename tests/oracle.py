"""Run a registered query next to its SQL twin and describe the first difference."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows_of(cols, rows):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in at) for r in rows]
    return [cols[i] for i in at], sorted(out, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def compare(spark, con, sf_dir, run, sql):
    df = run(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return (None, len(left[1]))
    cur = con.execute(sql)
    right = rows_of([c[0] for c in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return (f"columns {left[0]} != {right[0]}", len(left[1]))
    if len(left[1]) != len(right[1]):
        a, b = set(left[1]), set(right[1])
        return (f"rows {len(left[1])} != {len(right[1])}; only spark {list(a - b)[:2]}; only sql {list(b - a)[:2]}", len(left[1]))
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if bad:
        a, b = set(left[1]), set(right[1])
        return (f"{len(a - b)} rows differ; spark {list(a - b)[:2]} sql {list(b - a)[:2]}", len(left[1]))
    return (None, len(left[1]))


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from cuewright.plans.registry import catalog
    from cuewright.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    failed = 0
    for name, (run, sql) in catalog().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            error, n = compare(spark, con, sf_dir, run, sql)
        except Exception as exc:
            error, n = f"{type(exc).__name__}: {str(exc)[:900]}", -1
        failed += error is not None
        print(f"{'FAIL' if error else 'ok  '} {name} rows={n} {'' if sql else '(no sql) '}{time.time()-t:.1f}s {error or ''}", flush=True)
    print("failed", failed)
