"""Compare catalogue queries with their oracle SQL in DuckDB.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v).__name__), v if v is not None else 0) for v in row)


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def differences(df, con, sql: str) -> list[str]:
    names = sorted(df.columns)
    arrow = df.select(*[f"`{n}`" for n in names]).toArrow()
    res = con.execute(sql)
    got_names = [d[0] for d in res.description]
    out = []
    if sorted(got_names) != names:
        return [f"columns {names} != {sorted(got_names)}"]
    want = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})").to_arrow_table()
    types = [
        f"{n}: {arrow.schema.field(n).type} != {want.schema.field(n).type}"
        for n in names
        if str(arrow.schema.field(n).type).replace("large_", "") != str(want.schema.field(n).type).replace("large_", "")
    ]
    if types:
        out.append("types " + "; ".join(types))
    a = [tuple(_norm(v) for v in r) for r in zip(*[arrow.column(n).to_pylist() for n in names])]
    b = [tuple(_norm(v) for v in r) for r in zip(*[want.column(n).to_pylist() for n in names])]
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    a.sort(key=_key), b.sort(key=_key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} values differ, first {str(bad[0])[:600]}")
    if not a:
        out.append("note: no rows")
    return out


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from plaudit.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    chosen = argv[1:]
    spark, con = local_session(), connect(sf)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if chosen and name not in chosen:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                diff = differences(df, con, oracles[name])
            else:
                diff = [f"note: no oracle, {df.count()} rows"]
        except Exception as e:  # report and go on
            diff = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad = [d for d in diff if not d.startswith("note")]
        failed += bool(bad)
        print("FAIL" if bad else "ok  ", name, f"{time.time() - t0:.1f}s", *diff, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
