"""Runs queries beside their SQL: ``python tests/oracle.py [NAME...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    import datetime
    import decimal
    import math

    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1e8 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def difference(spark, sf_dir, query, sql) -> str:
    """What differs; empty if nothing does."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    at = [cols.index(c) for c in names]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())
    if mine != theirs:
        pairs = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b][:2]
        return f"{len(mine)} and {len(theirs)} rows; {names}: {pairs}"
    return "" if mine else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, sql, bad = e.queries(), e.oracle_sql(), 0
    for name in sys.argv[1:] or [n for n in queries if not n.startswith(("op", "pipeline"))]:
        began = time.time()
        try:
            said = difference(spark, "/root/testdata/sf0.01", queries[name], sql[name]) if name in sql else f"{queries[name](spark, '/root/testdata/sf0.01').count()} rows, no SQL"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:700]}"
        bad += bool(said) and "no SQL" not in said
        print(f"{name} {time.time() - began:.1f}s {said or 'ok'}", flush=True)
    print("bad:", bad)
