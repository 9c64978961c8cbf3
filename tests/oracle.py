"""Run every registered query beside its SQL in DuckDB and compare rows.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, run, sql: str) -> str | None:
    """None when names, rows and values agree, else what differs."""
    df = run(spark, folder)
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    expected, got = bag(names, answer.fetchall()), bag(df.columns, df.collect())
    if got == expected:
        return None
    extra, missing = list((got - expected).items())[:3], list((expected - got).items())[:3]
    return f"rows {sum(got.values())} <> {sum(expected.values())}; only spark {extra}; only sql {missing}"[:1500]


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from sluicegate.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wanted = sys.argv[2:] or list(queries())
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name in oracle_sql():
                problem = compare(spark, con, folder, queries()[name], oracle_sql()[name])
            else:
                problem = f"no SQL; {queries()[name](spark, folder).count()} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        print(f"{name:26s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
