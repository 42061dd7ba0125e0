"""Run registered queries against their SQL: python tests/compare.py [sf] [name prefix ...]."""

import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata"
VIEWS = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


def duck(sf: str):
    import duckdb
    con = duckdb.connect()
    for name in VIEWS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 9)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, name, build, sql, sf):
    """None if both agree, else what differs."""
    frame = build(spark, f"{DATA}/{sf}")
    left = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    done = con.execute(sql)
    right = canonical([d[0] for d in done.description], done.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    differ = [(a, b) for a, b in zip(left[1], right[1]) if repr(a) != repr(b)]
    return f"{len(differ)} of {len(left[1])} rows, first: {differ[0]}" if differ else None


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    sf, prefixes = (sys.argv[1] if len(sys.argv) > 1 else "sf0.01"), sys.argv[2:]
    spark, con, sqls = session(), duck(sf), oracle_sql()
    bad = 0
    for key, build in queries().items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        started = time.time()
        try:
            problem = compare(spark, con, key, build, sqls[key], sf) if key in sqls else "no SQL"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {key} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
