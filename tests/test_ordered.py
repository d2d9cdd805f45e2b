import random

import pytest
from pyspark.sql import functions as F

from tablesmith.operators.ordered import Running, chunked_by_rows, dense_index, hot_keys, lookup_join, running
from tablesmith.session import saved

@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    out = []
    for at in range(900):
        # A third of the rows belong to one key and a tenth to the null key.
        key = "hot" if at % 3 == 0 else None if at % 10 == 0 else f"k{random.randrange(40)}"
        out.append((at * 3 - 700, key, random.choice([None, *range(-20, 20)])))
    random.shuffle(out)
    return out


def brute(rows):
    state, result = {}, {}
    for at, key, v in sorted(rows):
        top, total, n, first = state.get(key, (None, None, 0, None))
        if v is not None:
            top, total, first = v if top is None else max(top, v), (total or 0) + v, v if first is None else first
        state[key] = (top, total, n + 1, first)
        result[at] = state[key]
    return result


@pytest.mark.parametrize("hot_rows, chunk_rows", [(10**6, 10**6), (50, 64), (0, 7), (200, 1000)])
def test_running_values_match_a_scan(spark, rows, hot_rows, chunk_rows):
    df = spark.createDataFrame(rows, "at long, k string, v int").repartition(7)
    values = {"top": Running("max", F.col("v")), "total": Running("sum", F.col("v")), "n": Running("count"), "first": Running("first", F.col("v"))}
    got = {r.at: (r.top, r.total, r.n, r.first) for r in running(df, ["k"], "at", values, hot_rows, chunk_rows).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("spread", ["at * 1000003", "at + 1000000000000 * (at div 300)", "at * at * at", "at"])
@pytest.mark.parametrize("grid", [1024, 4])
def test_running_values_with_gaps_in_the_order(spark, rows, spread, grid):
    """Chunks follow row counts, whatever the distances in the order are; a small grid cuts several times."""
    df = spark.createDataFrame(rows, "at long, k string, v int").selectExpr("at AS plain", f"{spread} AS at", "k", "v")
    ranks = {r.at: r.plain for r in df.collect()}
    values = {"top": Running("max", F.col("v")), "total": Running("sum", F.col("v")), "n": Running("count"), "first": Running("first", F.col("v"))}
    got = {ranks[r.at]: (r.top, r.total, r.n, r.first) for r in running(df, ["k"], "at", values, 50, 20, grid).collect()}
    assert got == brute(rows)
    hot = saved(hot_keys(df.select("k").na.fill("null"), ["k"], 50))
    sizes = chunked_by_rows(df.na.fill("null", ["k"]), ["k"], "at", hot, 20, grid).filter("__hot").groupBy("k", "__chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 40 and len(sizes) >= 15


@pytest.mark.parametrize("hot_rows", [10**6, 25, 1])
def test_lookup_join_keeps_every_row(spark, rows, hot_rows):
    left = spark.createDataFrame(rows, "at long, k string, v int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("unused", 4)], "k string, w int")
    got = sorted(((r.at, r.w) for r in lookup_join(left, right, ["k"], "at", "left", hot_rows).collect()), key=str)
    match = {"hot": 1, "k1": 2, "k2": 3}
    assert got == sorted(((at, match.get(k)) for at, k, _ in rows), key=str)


@pytest.mark.parametrize("chunk_rows", [1, 13, 500, 10**6])
def test_dense_index_is_dense_and_in_order(spark, rows, chunk_rows):
    df = spark.createDataFrame(rows, "at long, k string, v int").repartition(5)
    got = sorted((r.at, r["index"]) for r in dense_index(df, "at", chunk_rows=chunk_rows).collect())
    assert got == [(at, i) for i, at in enumerate(sorted(r[0] for r in rows))]


def test_running_plan_shuffles_the_wide_table_once(spark):
    df = spark.range(100).selectExpr("id AS at", "id % 5 AS k", "id AS v", "cast(id as string) AS wide")
    plan = running(df, ["k"], "at", {"top": Running("max", F.col("v"))})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_order_columns_must_be_whole_numbers(spark):
    df = spark.createDataFrame([(1.5, "a")], "at double, k string")
    with pytest.raises(ValueError, match="whole numbers"):
        running(df, ["k"], "at", {"n": Running("count")})
