"""Compare registered queries with their DuckDB statements.

    python tests/oracle_check.py 0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def _kind(t: str) -> str:
    t = t.lower()
    for prefix, kind in (("timestamp", "timestamp"), ("varchar", "string"), ("boolean", "boolean")):
        if t.startswith(prefix):
            return kind
    return t


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    types = {r[0]: _kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    mine = {n: _kind({"int": "integer"}.get(t, t)) for n, t in spark_df.dtypes}
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    wrong = [(g, e) for g, e in zip(got, expected) if g != e]
    if wrong:
        return f"{len(wrong)} rows differ, e.g. {wrong[0]}"
    if mine != types:
        return "types " + str({n: (mine[n], types[n]) for n in mine if mine[n] != types[n]})
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, oracle, con = entry.queries(), entry.oracle_sql(), connect(sf)
    bad = 0
    for name in sys.argv[2:] or list(queries):
        began = time.time()
        try:
            if name in oracle:
                verdict = compare(queries[name](spark, sf), con, oracle[name])
            else:
                verdict = None if queries[name](spark, sf).count() >= 0 else "?"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:400]}"
        bad += verdict is not None
        kind = "" if name in oracle else " (rows only)"
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name}{kind} {time.time() - began:.1f}s {verdict or ''}"[:900], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
