"""A parquet table changed by batches, each of which takes effect once, however often it is applied.

Rows lie in buckets of a hash of one column. Under ``path``, ``data/batch=<n>/__bucket=<b>`` holds what batch ``n`` wrote
for bucket ``b``, and ``commits`` has one row for each bucket a batch replaced; a bucket's rows are those of the newest
batch in ``commits``. A batch stages only the buckets its changes name and then appends its rows to ``commits`` as one
file, so readers see all of it or nothing. A batch that failed before that left nothing behind but staged files, which
its next run overwrites; one that is committed is not applied again.

The driver sees one short row per bucket, at most ``MOST_BUCKETS``. Batches are applied one at a time. Nulls of the
column are a value like any other. Files of replaced buckets stay, so earlier states can be read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.operators.changes import apply_changes, apply_grouped_changes

COMMITS = "number bigint, batch string, bucket int, rows bigint, column string, buckets int, layout string"
BUCKET = "__bucket"
MOST_BUCKETS = 65_536


@dataclass(frozen=True)
class State:
    """What is committed: batch names, layout, and per bucket the batch that wrote it last with its rows."""

    path: str
    column: str
    buckets: int
    schema: T.StructType
    batches: tuple[str, ...]
    newest: dict[int, tuple[int, int]]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.column).cast(self.schema[self.column].dataType)), F.lit(self.buckets)).cast("int")

    def rows(self, spark: SparkSession, only: Iterable[int] | None = None) -> DataFrame:
        """Current rows, of some buckets or all; other buckets' files are not listed."""
        wanted = self.newest if only is None else set(only) & self.newest.keys()
        places = [f"{self.path}/data/batch={number}/{BUCKET}={b}" for b in sorted(wanted) for number, rows in [self.newest[b]] if rows]
        return spark.read.schema(self.schema).parquet(*places) if places else spark.createDataFrame([], self.schema)


def state(spark: SparkSession, path: str, upto: str | None = None) -> State:
    """The committed state, or that after the batch ``upto``."""
    commits = spark.read.schema(COMMITS).parquet(f"{path}/commits")
    names = {r.number: r.batch for r in commits.select("number", "batch").distinct().collect()}
    if upto is not None:
        last = next((n for n, name in names.items() if name == upto), None)
        if last is None:
            raise ValueError(f"batch {upto!r} is not committed")
        commits, names = commits.filter(F.col("number") <= last), {n: name for n, name in names.items() if n <= last}
    first = commits.filter("number = 0").first()
    newest = commits.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.max_by(F.struct("number", "rows"), "number").alias("last"))
    return State(path, first["column"], first.buckets, T.StructType.fromJson(json.loads(first.layout)), tuple(names[n] for n in sorted(names)),
                 {r.bucket: (r.last.number, r.last.rows) for r in newest.collect()})


def read_table(spark: SparkSession, path: str, upto: str | None = None) -> DataFrame:
    """The table's rows, by default after the newest batch."""
    return state(spark, path, upto).rows(spark)


def create_table(df: DataFrame, path: str, column: str, buckets: int = 256, batch: str = "created") -> None:
    """Write the first state. Like other writes it refuses a table that is there."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"a table has 1 to {MOST_BUCKETS} buckets, not {buckets}")
    if BUCKET in df.columns:
        raise ValueError(f"column name {BUCKET!r} is taken by the table")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    empty = State(path, column, buckets, schema, (), {})
    df.sparkSession.createDataFrame([], COMMITS).write.mode("errorifexists").parquet(f"{path}/commits")
    _replace(df, empty, batch, range(buckets))


def apply_batch(spark: SparkSession, path: str, batch: str, changes: list[DataFrame], change: Callable[[DataFrame], DataFrame]) -> bool:
    """Replace the buckets named by ``changes`` (tables with the bucket column) by ``change`` of their rows.

    ``change`` must keep to those buckets; a row of another one fails the batch. False if the batch was applied before.
    """
    now = state(spark, path)
    if batch in now.batches:
        return False
    hashed = [table.select(now.bucket().alias("b")) for table in changes]
    named = {r.b for r in reduce(DataFrame.unionByName, hashed).distinct().collect()} if hashed else set()
    _replace(change(now.rows(spark, named)).select(*now.schema.names), now, batch, named)
    return True


def apply_change_batch(spark: SparkSession, path: str, batch: str, deletes: DataFrame | None = None, edits: DataFrame | None = None,
                       adds: DataFrame | None = None, seq: str | None = None) -> bool:
    """``changes.apply_changes`` as a batch; the table's column is the key."""
    key, parts = state(spark, path).column, [p for p in (deletes, edits, adds) if p is not None]
    return apply_batch(spark, path, batch, parts, lambda base: apply_changes(base, key, deletes, edits, adds, seq))


def apply_grouped_change_batch(spark: SparkSession, path: str, batch: str, group: str, order: str, deletes: DataFrame | None = None,
                               edits: DataFrame | None = None, adds: DataFrame | None = None, seq: str | None = None) -> bool:
    """``changes.apply_grouped_changes`` as a batch; the table's column is the name that deletes and edits give."""
    name, parts = state(spark, path).column, [p for p in (deletes, edits, adds) if p is not None]
    return apply_batch(spark, path, batch, parts, lambda base: apply_grouped_changes(base, group, name, order, deletes, edits, adds, seq=seq))


def _replace(df: DataFrame, now: State, batch: str, named: Iterable[int]) -> None:
    """Stage the rows of the named buckets, then commit them. A hot bucket is written by several tasks."""
    named, spark, number = sorted(named), df.sparkSession, len(now.batches)
    inside = now.bucket() if len(named) == now.buckets else F.when(now.bucket().isin(named), now.bucket()).otherwise(
        F.raise_error(F.lit(f"batch {batch} makes a row outside the buckets its changes name")).cast("int"))
    placed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in now.schema.fields]).withColumn(BUCKET, inside)
    staged = f"{now.path}/data/batch={number}"
    placed.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(staged)
    written = spark.read.schema(T.StructType([*now.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(staged)
    rows = {r[BUCKET]: r["count"] for r in written.groupBy(BUCKET).count().collect()}
    _commit(spark, now, [(number, batch, b, rows.get(b, 0), now.column, now.buckets, now.schema.json()) for b in named or [None]])


def _commit(spark: SparkSession, now: State, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").parquet(f"{now.path}/commits")
