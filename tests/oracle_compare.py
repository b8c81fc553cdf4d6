"""Compare every registered Spark query with its DuckDB oracle SQL.

Usage: python tests/oracle_compare.py [sf_dir] [name,name,...]

For each query: row count, sorted column names and an order-insensitive
hash of the values (floats rounded to 6 decimals, everything else as text).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v) -> str:
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<nan>"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def digest(rows: list[tuple], cols: list[str]) -> tuple[int, list[str], str, list[tuple]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\x1e".join(lines).encode()).hexdigest()
    return len(rows), [cols[i] for i in order], h, lines


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    t_spark = time.time() - t0
    s = digest(s_rows, df.columns)
    out = {"name": name, "rows": s[0], "spark_s": round(t_spark, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    t1 = time.time()
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    o = digest([tuple(r) for r in res.fetchall()], cols)
    out["duck_s"] = round(time.time() - t1, 2)
    if s[1] != o[1]:
        out["status"] = f"COLUMNS spark={s[1]} oracle={o[1]}"
    elif s[0] != o[0]:
        out["status"] = f"ROWS spark={s[0]} oracle={o[0]}"
    elif s[2] != o[2]:
        a, b = set(s[3]), set(o[3])
        out["status"] = "VALUES"
        out["only_spark"] = sorted(a - b)[:3]
        out["only_oracle"] = sorted(b - a)[:3]
    else:
        out["status"] = "match"
    return out


def main() -> None:
    import __spark_entry__ as E
    from newsweave.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2].split(",")) if len(sys.argv) > 2 else None
    spark = build_session(8)
    # optional hostile session settings, as a driver might have them
    for env, key in (("NW_TZ", "spark.sql.session.timeZone"), ("NW_ANSI", "spark.sql.ansi.enabled"),
                     ("NW_PARTS", "spark.sql.shuffle.partitions")):
        if os.environ.get(env):
            spark.conf.set(key, os.environ[env])
    con = duck(sf_dir)
    sqls = E.oracle_sql()
    for name, fn in E.queries().items():
        if only and name not in only:
            continue
        try:
            r = compare(spark, name, fn, sqls.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        print(r, flush=True)


if __name__ == "__main__":
    main()
