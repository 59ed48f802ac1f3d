"""Holds Spark results against DuckDB: row count, column names and values, whatever the order."""

import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def compare(spark, con, query, sql, sf_dir):
    """None, or what differs."""
    t = time.time()
    got_df = query(spark, sf_dir)
    names = sorted(got_df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in got_df.select(*[f"`{n}`" for n in names]).collect())
    spark_s = time.time() - t
    t = time.time()
    rel = con.execute(sql)
    have = [d[0] for d in rel.description]
    if sorted(have) != names:
        return f"columns {names} and {sorted(have)}", spark_s, 0
    at = [have.index(n) for n in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    duck_s = time.time() - t
    if got != want:
        first = next((p for p in zip(got, want) if p[0] != p[1]), None)
        return f"{len(got)} and {len(want)} rows; first difference {str(first)[:700]}", spark_s, duck_s
    return None, spark_s, duck_s
