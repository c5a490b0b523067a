"""Compare registered queries with their oracle SQL on one scale folder.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def spark_session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("compare")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.host", "127.0.0.1").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return plain(list(v.asDict().values()))
    if isinstance(v, dict):
        return plain(sorted(v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, con, name, fn, sql, folder):
    df = fn(spark, folder)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = table_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return (f"{len(got[1])} vs {len(want[1])} rows; spark only {sorted(a - b)[:3]}; "
                f"sql only {sorted(b - a)[:3]}"), len(got[1])
    return None, len(got[1])


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con = spark_session(), duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            if name in oracles:
                diff, n = differences(spark, con, name, queries[name], oracles[name], folder)
            else:
                diff, n = None, queries[name](spark, folder).count()
        except Exception as e:  # report and go on
            diff, n = "error " + "".join(traceback.format_exception_only(e))[:1500], -1
        bad += diff is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'BAD' if diff else 'ok '} {name} [{kind}] {n} rows {time.time() - t:.1f}s {diff or ''}",
              flush=True)
    print("bad", bad, "of", len(names or queries))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001",
                       sys.argv[2:]) else 0)
