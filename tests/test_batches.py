"""Tables changed by batches, and documents from one exchange."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablesmith.operators import changes as C
from tablesmith.operators import views as W
from tablesmith.sources import batches as B
from tablesmith.spec import EventSpec


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def base(spark):
    return spark.range(200).select("id", F.concat(F.lit("v"), "id").alias("v"), F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("n"))


@pytest.fixture
def made(base, tmp_path):
    path = str(tmp_path / "t")
    B.create_table(base, path, "id", buckets=8)
    return path


def test_a_batch_that_fails_half_way_changes_nothing_and_counts_once(spark, base, made):
    deletes, edits = base.filter("id < 20").select("id"), base.filter("id % 10 = 5").select("id", F.lit("new").alias("v"))
    adds = spark.range(1000, 1010).select("id", F.lit("added").alias("v"))
    stopped = adds.withColumn("v", F.when(F.col("id") == 1009, F.raise_error(F.lit("stop"))).otherwise(F.col("v")))
    with pytest.raises(PySparkException):
        B.apply_change_batch(spark, made, "one", deletes, edits, stopped)
    assert rows(B.read_table(spark, made)) == rows(base)
    assert B.apply_change_batch(spark, made, "one", deletes, edits, adds)
    want = rows(C.apply_changes(base, "id", deletes, edits, adds))
    assert rows(B.read_table(spark, made)) == want
    assert not B.apply_change_batch(spark, made, "one", None, None, spark.range(5000, 5001))
    assert rows(B.read_table(spark, made)) == want
    assert rows(B.read_table(spark, made, upto="created")) == rows(base)
    with pytest.raises(ValueError, match="not committed"):
        B.read_table(spark, made, upto="two")


def test_staged_but_not_committed_is_not_read_and_is_overwritten(spark, base, made, monkeypatch):
    edits = base.select("id", F.lit("lost").alias("v"))
    with monkeypatch.context() as patched:
        patched.setattr(B, "_commit", lambda *a: (_ for _ in ()).throw(OSError("driver lost")))
        with pytest.raises(OSError):
            B.apply_change_batch(spark, made, "one", edits=edits)
    assert rows(B.read_table(spark, made)) == rows(base)
    few = base.filter("id = 3").select("id", F.lit("kept").alias("v"))
    assert B.apply_change_batch(spark, made, "other", edits=few)
    assert rows(B.read_table(spark, made)) == rows(C.apply_changes(base, "id", edits=few))


def test_only_named_buckets_are_written_and_read(spark, base, made):
    before = {f for f in B.read_table(spark, made).inputFiles()}
    B.apply_change_batch(spark, made, "one", edits=spark.createDataFrame([(3, "x")], "id int, v string"))
    after = {f for f in B.read_table(spark, made).inputFiles()}
    gone = {re.search(r"__bucket=\d+", f).group() for f in before - after}
    assert len(gone) == 1 and len(before & after) >= 7
    assert rows(B.read_table(spark, made).filter("id = 3")) == ["Row(id=3, v='x', n=3)"]


def test_emptied_buckets_empty_batches_and_tables(spark, base, made, tmp_path):
    assert B.apply_change_batch(spark, made, "none", deletes=base.filter("false").select("id"))
    assert rows(B.read_table(spark, made)) == rows(base)
    assert B.apply_change_batch(spark, made, "all", deletes=base.select("id"))
    assert B.read_table(spark, made).count() == 0
    assert B.apply_change_batch(spark, made, "back", adds=base.filter("id = 1"))
    assert rows(B.read_table(spark, made)) == rows(base.filter("id = 1"))
    empty = str(tmp_path / "empty")
    B.create_table(base.filter("false"), empty, "id", buckets=2)
    assert rows(B.read_table(spark, empty)) == [] and B.read_table(spark, empty).dtypes == base.dtypes


def test_strict_renames_cross_buckets_and_strays_fail(spark, base, made):
    edits = spark.createDataFrame([(1, "moved", 900), (2, None, 901)], "id long, v string, new long")
    named = [edits.select("id"), edits.select(F.col("new").alias("id"))]
    assert B.apply_batch(spark, made, "renamed", named, lambda old: C.apply_changes_strict(old, "id", edits=edits, renamed="new"))
    assert rows(B.read_table(spark, made)) == rows(C.apply_changes_strict(base, "id", edits=edits, renamed="new"))
    with pytest.raises(PySparkException, match="outside the buckets"):
        B.apply_batch(spark, made, "stray", [spark.range(5, 6)], lambda old: old.unionByName(base))
    with pytest.raises(PySparkException):
        B.create_table(base, made, "id")
    with pytest.raises(ValueError):
        B.create_table(base, made + "x", "id", buckets=0)


def test_null_names_and_repeated_rows_stay(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 1), ("b", "x", 2), (None, "x", 3)], "g string, name string, at int")
    path = str(tmp_path / "t")
    B.create_table(df, path, "name", buckets=4)
    edits = spark.createDataFrame([("x", 9)], "name string, at int")
    for _ in range(2):
        B.apply_grouped_change_batch(spark, path, "one", "g", "at", edits=edits)
    assert rows(B.read_table(spark, path)) == rows(df.withColumn("at", F.when(F.col("name") == "x", 9).otherwise(F.col("at"))))


EVENTS = (EventSpec("VIEW", 1), EventSpec("CLICK", 2))


def histories(spark):
    return spark.range(600).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 40)).alias("entity"),
                                   F.element_at(F.array(F.lit("VIEW"), F.lit("CLICK"), F.lit("OTHER"), F.lit("")), (F.col("id") % 4 + 1).cast("int")).alias("event_type"),
                                   F.when(F.col("id") % 5 > 0, F.col("id")).alias("account_id"))


@pytest.mark.parametrize("hot_rows", [1000, 100, 0])
def test_nest_is_the_same_for_hot_and_other_entities(spark, hot_rows):
    df = histories(spark)
    got = {d.entity: d for d in W.nest(df, "entity", EVENTS, "id", 3, hot_rows=hot_rows).collect()}
    plain = df.collect()
    assert set(got) == {r.entity for r in plain}
    for entity, document in got.items():
        mine = [r for r in plain if r.entity == entity]
        assert document.account_id == mine[-1].account_id
        kinds = {}
        for r in mine:
            kinds.setdefault(r.event_type or "BUSINESS_EVENT", []).append(r)
        order = sorted(kinds, key=lambda t: ({"VIEW": 1, "CLICK": 2}.get(t, 3), kinds[t][0].id))
        assert [(e.event_type, e.totalCount, [r.id for r in e.records]) for e in document.events] == [
            (t, len(kinds[t]), [r.id for r in kinds[t][-3:]]) for t in order]


def test_nest_moves_the_wide_table_once(spark):
    df = histories(spark)
    plan = W.nest(df, "entity", EVENTS, "id", 3)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan.split("Initial Plan")[-1])) == 1, plan


def test_documents_are_made_in_parts_of_a_number_of_rows(spark, monkeypatch):
    df = histories(spark)
    want = rows(W.nest(df, "entity", EVENTS, "id", 3))
    monkeypatch.setattr(W, "TASK_ROWS", 10)
    made = W.nest(df, "entity", EVENTS, "id", 3)
    assert re.search(r"hashpartitioning\(entity#\d+, 60\)", made._jdf.queryExecution().executedPlan().toString())
    assert rows(made) == want


def test_only_names_with_adds_are_matched_with_the_adds(spark):
    base = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), (None, "x", 4), ("a", None, 5), ("c", "z", 6)], "g string, name string, at int")
    adds = spark.createDataFrame([("a", "x", 9), ("n", "x", 8), ("n", "w", 7)], "g string, name string, at int")
    changed = C.apply_grouped_changes(base, "g", "name", "at", adds=adds)
    assert rows(changed) == sorted(map(repr, [*base.filter("NOT (g <=> 'a' AND name <=> 'x')").collect(), *adds.collect()]))
    matched = re.search(r"Join LeftAnti.*?(?=\n *(?::- |\+- )Project.*__adds|\Z)", C.apply_grouped_changes(
        base, "g", "name", "at", adds=adds)._jdf.queryExecution().analyzed().toString(), re.S)
    assert matched and "__adds" in matched.string[matched.start():]
