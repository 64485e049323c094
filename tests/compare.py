"""Runs queries against their SQL in DuckDB: python tests/compare.py DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differ(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None if both agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return f"{len(got)} and {len(want)} rows; only Spark {a}; only SQL {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from loomlake.workspace import session

    spark = session(**{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    every, sqls, con = entry.queries(), entry.oracle_sql(), tables(sf)
    for name in names or every:
        began = time.time()
        try:
            said = differ(spark, con, name, every[name], sqls[name], sf) if name in sqls else f"rows only: {every[name](spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        mark = "ok  " if said is None else "rows" if said.startswith("rows only") else "BAD "
        print(f"{mark} {name} {time.time() - began:.1f}s {said or ''}"[:1100], flush=True)
