"""Runs registered queries beside their oracle SQL on DuckDB and compares rows as sorted multisets.

python -m tests.oracle SF NAME... (all names with oracle SQL by default)
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_cell, x))
    if isinstance(x, dict):
        return tuple(_cell(v) for v in x.values())
    if hasattr(x, "asDict"):
        return tuple(_cell(v) for v in x)
    return x if x is None or isinstance(x, (int, str, bool)) else str(x)


def rows(names: list[str], values: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in values), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> tuple[int, str]:
    """Number of rows, and what differs ('' if nothing)."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} against {sorted(names)}"
    want = rows(names, cur.fetchall())
    if got != want:
        odd = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return len(got), f"{len(got)} rows against {len(want)}; {sorted(names)}; {odd}"
    return len(got), ""


def main() -> None:
    import __spark_entry__ as e

    from tests.conftest import session

    spark, sf = session(), sys.argv[1]
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or [n for n in q if n in o]:
        t = time.time()
        try:
            n, why = compare(spark, f"/root/testdata/{sf}", q[name], o[name])
        except Exception as x:  # noqa: BLE001
            n, why = -1, f"{type(x).__name__}: {str(x)[:700]}"
        bad += bool(why)
        print(f"{'BAD' if why else 'ok '} {name}: {n} rows, {time.time() - t:.1f} s {why[:1200]}", flush=True)
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
