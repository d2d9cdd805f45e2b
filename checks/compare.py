"""Run registered queries next to their SQL and compare whole results.

    python -m checks.compare [sf_dir] [name prefix or section: ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from checks import all_queries
from tablesmith.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    """A value in a form both engines share."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (int, float)):
        return "nan" if isinstance(value, float) and math.isnan(value) else float(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, name: str, run, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    began = time.time()
    df = run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - began
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.2f}s"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        differing = [(g, w) for g, w in zip(got, want) if g != w]
        return False, f"{len(got)} vs {len(want)} rows, {len(differing)} differ, first {differing[:1]}"
    return True, f"{len(got)} rows, {took:.2f}s"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("compare", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
                                        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    queries, oracles = all_queries()
    for name, run in queries.items():
        if prefixes and not (name.startswith(prefixes) or f"{run.__module__.split('.')[-1]}:" in prefixes):
            continue
        try:
            ok, note = compare(spark, con, name, run, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main())
