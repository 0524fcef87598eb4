"""Run registered queries against their oracle: ``python -m tests.compare [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, int):
            v = float(v)
        return repr(v)

    return sorted(tuple(cell(v) for v in row) for row in df[cols].itertuples(index=False, name=None))


def compare(spark, con, sf: str, fn, sql: str | None) -> tuple[bool, str]:
    t = time.time()
    got = fn(spark, sf).toPandas()
    el = time.time() - t
    if sql is None:
        return len(got) > 0, f"rows={len(got)} {el:.2f}s (no oracle)"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = _canon(got), _canon(want)
    if a == b:
        nulls = [c for c in got.columns if len(got) and got[c].isna().all()]
        return len(a) > 0, f"rows={len(a)} {el:.2f}s" + (f" ALL-NULL {nulls}" if nulls else "")
    sa, sb = set(a), set(b)
    return False, (
        f"rows {len(a)} vs {len(b)} {sorted(got.columns)}\n   only spark: {sorted(sa - sb)[:3]}"
        f"\n   only oracle: {sorted(sb - sa)[:3]} diff={len(sa - sb)}"
    )


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from panelweft.session import local_session

    sf = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("sf"):
        sf = f"/root/testdata/{argv.pop(0)}"
    spark = local_session(8)
    con = connect(sf)
    bad = 0
    oracles = e.oracle_sql()
    for name, fn in e.queries().items():
        if argv and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        try:
            ok, msg = compare(spark, con, sf, fn, oracles.get(name))
        except Exception as exc:  # noqa: BLE001
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, msg, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
