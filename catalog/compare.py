"""Run registered queries against their SQL: python -m catalog.compare [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        f = float(v)
        return int(f) if f.is_integer() else f
    if hasattr(v, "is_finite"):
        f = float(v)
        return int(f) if f.is_integer() else f
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main(argv: list[str]) -> int:
    import catalog
    from catalog.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    catalog.load()
    names = argv[1:] or list(catalog.QUERIES)
    spark, con = local_session(), connect(sf_dir)
    bad = []
    for name in names:
        t0 = time.time()
        try:
            df = catalog.QUERIES[name](spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            sql = catalog.ORACLE.get(name)
            if sql is None:
                print(f"rows   {name:32s} {len(got):7d} rows  {t1 - t0:6.2f}s", flush=True)
                continue
            cur = con.execute(sql)
            columns = [c[0] for c in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            problem = None
            if sorted(columns) != sorted(df.columns):
                problem = f"columns {sorted(df.columns)} vs {sorted(columns)}"
            else:
                a, b = rows_of(df.columns, got), rows_of(columns, want)
                if a != b:
                    sa, sb = set(map(repr, a)), set(map(repr, b))
                    problem = f"rows {len(a)} vs {len(b)}\n   spark only {sorted(sa - sb)[:2]}\n   sql only   {sorted(sb - sa)[:2]}"
            if problem is None and not want:
                problem = "EMPTY RESULT"
            print(f"{'ok' if problem is None else 'DIFF':6s} {name:32s} {len(got):7d} rows  {t1 - t0:6.2f}s sql {t2 - t1:6.2f}s", flush=True)
            if problem:
                print("  ", problem[:1500], flush=True)
                bad.append(name)
        except Exception as e:  # noqa: BLE001 - a report of all failures is wanted
            print(f"ERROR  {name}: {str(e)[:700]}", flush=True)
            bad.append(name)
    print(f"{len(names)} queries, {len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
