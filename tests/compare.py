"""Run a registered query next to its SQL and compare them as bags of rows."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    return str(v)


def compare(spark, con, name, fn, sql, sf_dir):
    """'' when equal, else a short account of the difference."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if sql is None:
        return "" if got else "no rows"
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} against {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in cols]
    rows = rel.fetchall()
    want = sorted(tuple(norm(r[i]) for i in order) for r in rows)
    if got == want:
        return "" if got else "equal but no rows"
    only_s, only_d = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
    return f"{len(got)} rows against {len(want)}; {cols}\n   spark {only_s}\n   sql   {only_d}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from auditkit.session import local_session

    sf = os.environ.get("SF", "0.01")
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = duck(sf_dir)
    qs, os_ = e.queries(), e.oracle_sql()
    names = [n for n in qs if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    bad = 0
    for n in names:
        t = time.time()
        try:
            msg = compare(spark, con, n, qs[n], os_.get(n), sf_dir)
        except Exception as x:  # noqa: BLE001
            msg = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += bool(msg)
        tag = ("ok  " if n in os_ else "rows") if not msg else "FAIL"
        print(f"{tag} {n} {time.time() - t:.1f}s {msg}", flush=True)
    print(f"{len(names)} queries, {bad} failing, {sum(n in os_ for n in names)} with sql")
