"""Run registered queries and their SQL side by side: python tests/check_oracles.py [sf] [name ...]"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def digest(columns, rows) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    texts = sorted(repr([_norm(row[i]) for i in order]) for row in rows)
    return len(texts), hashlib.sha256("\n".join(texts).encode()).hexdigest()


_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double",
    "TIMESTAMP": "timestamp_ntz",
}


def compare(spark, connection, name: str, sf_dir: str) -> str:
    started = time.time()
    frame = entry_module.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    spent = time.time() - started
    if name not in entry_module.oracle_sql():
        return f"rows-only n={len(rows)} {spent:.1f}s"
    started = time.time()
    relation = connection.sql(entry_module.oracle_sql()[name])
    expected = relation.fetchall()
    duck_time = time.time() - started
    want = dict(zip(relation.columns, (_TYPES.get(str(t), str(t)) for t in relation.types)))
    got = dict(frame.dtypes)
    if want != got:
        return f"SCHEMA {got} != {want}"
    left, right = digest(frame.columns, rows), digest(relation.columns, expected)
    if left != right:
        a = {repr(sorted(zip(frame.columns, r))) for r in rows}
        b = {repr(sorted(zip(relation.columns, r))) for r in expected}
        return f"VALUES {left[0]} vs {right[0]}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    return f"ok n={left[0]} spark {spent:.1f}s sql {duck_time:.1f}s"


if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    for name in sys.argv[2:] or entry_module.queries():
        try:
            result = compare(spark, connection, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__} {str(error)[:300]}"
        print(f"{name}: {result}", flush=True)
