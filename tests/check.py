"""Run registered queries against their SQL twins: python tests/check.py [sf_dir] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    from valuwatch.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


def key(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def compare(spark_df, con, sql) -> tuple[bool, str]:
    a, ac = key([tuple(r) for r in spark_df.collect()], spark_df.columns)
    res = con.execute(sql)
    b, bc = key(res.fetchall(), [d[0] for d in res.description])
    if ac != bc:
        return False, f"columns {ac} vs {bc}"
    if a == b:
        return True, f"{len(a)} rows"
    left, right = set(a) - set(b), set(b) - set(a)
    return False, (f"{len(a)} vs {len(b)} rows, {len(left)}/{len(right)} differ; "
                   f"spark {sorted(left)[:2]} sql {sorted(right)[:2]} columns {ac}")


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from valuwatch.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session(cpus=8), duck(sf_dir)
    qs, oracles = queries(), oracle_sql()
    bad = 0
    for name in argv[1:] or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in oracles:
                t1 = time.time()
                ok, note = compare(df, con, oracles[name])
            else:
                t1 = time.time()
                ok, note = True, f"{len(df.collect())} rows, no SQL"
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {time.time() - t0:6.2f}s {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
