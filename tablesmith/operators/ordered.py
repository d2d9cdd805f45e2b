"""Running values and row numbers per key that hold up when one key owns much of the table.

A window over a key puts all its rows in one task. Here a key with more than ``hot_rows`` rows is cut
into chunks of consecutive arrivals, each chunk is scanned on its own, and the value carried in from
earlier chunks comes from a small table with one row per chunk. Other keys are one chunk each, so the
data is shuffled once either way.

Chunks are cut by row counts: a quantile sketch of a hot key's ``order`` (a unique whole number, arrival)
gives the cuts, so dense, sparse and clustered orders make chunks of about ``chunk_rows`` rows. A key of
more than ``GRID`` chunks is cut again inside its chunks. The broadcast lists are the hot keys, at most
table rows / ``hot_rows``, and their cuts, at most table rows / ``chunk_rows`` whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions import values as V
from tablesmith.session import saved

HOT_ROWS = 4_000_000
CHUNK_ROWS = 1_000_000
GRID = 1024  # quantiles of one sketch; the sketch's own error is a tenth of their distance


@dataclass(frozen=True)
class Running:
    """One running value: ``max``, ``sum``, ``count`` or ``first`` (non-null) of a column."""

    kind: str
    column: Column | None = None

    def total(self, order: Column) -> Column:
        if self.kind == "max":
            return F.max(self.column)
        if self.kind == "sum":
            return F.sum(self.column)
        if self.kind == "count":
            return F.count(F.lit(1))
        return F.min_by(self.column, F.when(self.column.isNotNull(), order))

    def scan(self, window) -> Column:
        if self.kind == "first":
            return F.first(self.column, ignorenulls=True).over(window)
        return self.total(F.lit(0)).over(window)

    def carry(self, c: Column, window) -> Column:
        """Combine the totals of earlier chunks."""
        if self.kind == "first":
            return F.first(c, ignorenulls=True).over(window)
        return (F.max(c) if self.kind == "max" else F.sum(c)).over(window)

    def join(self, before: Column, here: Column) -> Column:
        if self.kind == "first":
            return F.coalesce(before, here)
        if self.kind == "max":
            return F.greatest(before, here)
        return F.when(before.isNull(), here).otherwise(before + F.coalesce(here, F.lit(0)))


# Stand-ins for null keys by type; a flag column keeps them apart from real values.
BLANKS = ((T.StringType, ""), (T.BooleanType, False), (V.NUMERIC, 0), ((T.TimestampType, T.TimestampNTZType, T.DateType), "1970-01-01"))


def whole_div(c: Column, n: int) -> Column:
    """Floor division of whole numbers, exact at any size."""
    return F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n))


def check_order(df: DataFrame, order: str) -> None:
    if not isinstance(df.schema[order].dataType, V.INTEGRAL):
        raise ValueError(f"order column {order!r} must hold unique whole numbers")


def with_group_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Add non-null copies of the keys, so grouping, windows and joins share one partitioning and null is a key too."""
    added = {}
    for k in keys:
        dtype = df.schema[k].dataType
        blank = next((b for kind, b in BLANKS if isinstance(dtype, kind)), None)
        if blank is None:
            raise ValueError(f"column {k!r} of type {dtype.simpleString()} cannot be a key")
        added[f"__key_{k}"] = F.coalesce(F.col(k), F.lit(blank).cast(dtype))
    added["__nulls"] = F.concat(*[F.when(F.col(k).isNull(), "1").otherwise("0") for k in keys])
    return df.withColumns(added), list(added)


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Keys with more than hot_rows rows and their row counts. Counts are combined before the shuffle; at most
    table rows / hot_rows keys remain, which is what bounds the broadcasts below."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return counts.filter(F.col("__rows") > hot_rows)


def cuts_below(cuts: Column, at: Column, grid: int) -> Column:
    """How many of the sorted cuts are at or below a value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(grid.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda done, step: F.when(F.get(cuts, done + step - 1) <= at, done + step).otherwise(done))


def quantile_cuts(rows: DataFrame, parts: list[str], order: str, pieces: DataFrame, chunk_rows: int, grid: int) -> DataFrame:
    """For each piece (parts, __rows): its cuts into chunks of about chunk_rows rows, as one sorted array."""
    marks = [k / grid for k in range(1, grid)]
    sketch = F.percentile_approx(F.col(order).cast("bigint"), marks, 10 * grid)
    found = rows.join(F.broadcast(pieces), parts).groupBy(*parts).agg(F.first("__rows").alias("__rows"), sketch.alias("__marks"))
    n = F.least(F.lit(grid), F.ceil(F.col("__rows") / chunk_rows)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.get("__marks", F.round(k * grid / n).cast("int") - 1))
    return found.select(*parts, F.when(n > 1, F.array_distinct(picked)).otherwise(F.array().cast("array<bigint>")).alias("__cuts"))


def chunked_by_rows(keyed: DataFrame, group: list[str], order: str, hot: DataFrame, chunk_rows: int, grid: int = GRID) -> DataFrame:
    """Add ``__chunk``, rising with the order inside a key, and ``__hot`` for keys that are cut.

    ``hot`` (saved) has the keys to cut and their row counts. Only keys and orders are read for the sketches.
    """
    out = keyed.join(F.broadcast(hot.select(*group, F.lit(True).alias("__hot"))), group, "left").withColumn("__chunk", F.lit(0).cast("bigint"))
    parts, pieces = [*group, "__chunk"], hot.withColumn("__chunk", F.lit(0).cast("bigint"))
    while most := pieces.agg(F.max("__rows")).first()[0]:
        cuts = saved(quantile_cuts(out.filter("__hot").select(*parts, order), parts, order, pieces, chunk_rows, grid))
        place = F.when(F.col("__cuts").isNull(), 0).otherwise(cuts_below(F.col("__cuts"), F.col(order), grid))
        out = out.join(F.broadcast(cuts), parts, "left").withColumn("__chunk", F.col("__chunk") * grid + place).drop("__cuts")
        if most <= grid * chunk_rows:
            break
        pieces = saved(hot_keys(out.filter("__hot").select(*parts), parts, 2 * chunk_rows))
    return out


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, Running], hot_rows: int = HOT_ROWS,
            chunk_rows: int = CHUNK_ROWS, grid: int = GRID) -> DataFrame:
    """Add running values over each key in arrival order, current row included. Null is a key like any other.

    Keys are counted first (a small job of its own); without a hot key the scan is a plain window.
    """
    check_order(df, order)
    keyed, group = with_group_keys(df, keys)
    hot = saved(hot_keys(keyed.select(*group), group, hot_rows))
    if hot.isEmpty():
        within = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return keyed.select(*df.columns, *[v.scan(within).alias(n) for n, v in values.items()])
    at, parts = F.col(order), [*group, "__chunk"]
    chunked = chunked_by_rows(keyed, group, order, hot, chunk_rows, grid)

    totals = chunked.filter("__hot").groupBy(*parts).agg(*[v.total(at).alias(f"__{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*parts, *[v.carry(F.col(f"__{n}"), earlier).alias(f"__before_{n}") for n, v in values.items()])

    within = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = chunked.select(*df.columns, *parts, *[v.scan(within).alias(f"__here_{n}") for n, v in values.items()])
    joined = here.join(before, parts, "left")
    return joined.select(*df.columns, *[v.join(F.col(f"__before_{n}"), F.col(f"__here_{n}")).alias(n) for n, v in values.items()])


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "left",
                hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """Join to a table with one row per key. Rows of a hot left key are spread over copies of its match, one copy
    per hot_rows rows, so no task gets more than about that many rows of one key. Null keys match nothing and are spread too.
    ``counts`` (keys, __rows) are the left rows of each key that has a match, where they are known."""
    hot = hot_keys(left.select(*keys), keys, hot_rows) if counts is None else counts.filter(F.col("__rows") > hot_rows)
    hot = hot.select(*keys, F.ceil(F.col("__rows") / hot_rows).cast("int").alias("__copies"))
    copies = F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1)
    fanned = right.join(F.broadcast(hot), keys, "left").select(*right.columns, F.explode(copies).alias("__copy"))
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    copies_of = F.when(missing, 1 << 20).otherwise(F.coalesce("__copies", F.lit(1)))
    copy = F.pmod(F.xxhash64(spread), copies_of).cast("int")
    salted = left.join(F.broadcast(hot), keys, "left").select(*left.columns, copy.alias("__copy"))
    return salted.join(fanned, [*keys, "__copy"], how).drop("__copy")


def chunk_sizes(df: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows per chunk of a whole-number key, one row per chunk, kept in the shared folder so that it is counted once."""
    return saved(df.groupBy(whole_div(F.col(key), chunk_rows).alias("__chunk")).agg(F.count(F.lit(1)).alias("__n")))


def total_rows(sizes: DataFrame) -> int:
    return sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first().n


def dense_index(df: DataFrame, key: str, name: str = "index", chunk_rows: int = CHUNK_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Number rows 0, 1, ... in order of a unique whole-number key, without a global window.

    Rows are ranked inside chunks of the key range; chunk offsets are summed in two steps, so the last
    step sees one row per million chunks.
    """
    sizes = (chunk_sizes(df, key, chunk_rows) if sizes is None else sizes).withColumn("__block", whole_div(F.col("__chunk"), 1_000_000))
    above = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("__block").agg(F.sum("__n").alias("__bn"))
    bases = F.sum("__bn").over(above(Window.partitionBy(F.lit(0)).orderBy("__block")))
    blocks = blocks.select("__block", F.coalesce(bases, F.lit(0)).alias("__base"))
    inside = F.sum("__n").over(above(Window.partitionBy("__block").orderBy("__chunk")))
    offsets = sizes.join(blocks, "__block").select("__chunk", (F.col("__base") + F.coalesce(inside, F.lit(0))).alias("__offset"))
    rank = F.row_number().over(Window.partitionBy("__chunk").orderBy(key)) - 1
    check_order(df, key)
    ranked = df.withColumn("__chunk", whole_div(F.col(key), chunk_rows)).withColumn("__rank", rank)
    return ranked.join(offsets, "__chunk").select(*df.columns, (F.col("__offset") + F.col("__rank")).alias(name))
