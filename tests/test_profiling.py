"""Learned constraints and profiles given as tables."""

import random

import pytest
from pyspark.sql import functions as F

from tablesmith.operators import naming as N
from tablesmith.operators.profiling import column_sketches, learned_rules, profile_columns


def test_choices_and_free_text_are_told_apart_exactly_at_the_bound(spark):
    df = spark.range(900).select(
        (F.col("id") % 20).cast("string").alias("at_bound"), (F.col("id") % 21).cast("string").alias("above"), F.col("id").cast("string").alias("free"),
        F.when(F.col("id") > 5, F.lit("x")).alias("holes"), F.lit(None).cast("string").alias("none"), (F.col("id") / 10).alias("number"))
    kinds, words = profile_columns(df, max_choices=20)
    rows = {r.field: r for r in kinds.collect()}
    assert {n: r.kind for n, r in rows.items()} == {"at_bound": "choice", "above": "text", "free": "text", "holes": "choice", "none": "choice", "number": "number"}
    assert (rows["holes"].nulls, rows["holes"].different, rows["none"].different) == (6, 1, 0)
    assert (rows["number"].lo, rows["number"].hi, rows["number"].quartiles[1]) == (0.0, 89.9, pytest.approx(44.9, abs=0.2))
    assert {r.field for r in words.select("field").distinct().collect()} == {"at_bound", "holes", "none"}
    assert learned_rules(df, ["holes", "none", "number", "free"], 20) == {"holes": {"valid_values": ["x"]}, "number": {"min": 0.0, "max": 89.9}}


def test_an_empty_table_has_a_profile_and_no_rules(spark):
    empty = spark.createDataFrame([], "a string, b double")
    assert {r.field: (r.rows, r.nulls, r.lo, r.longest) for r in column_sketches(empty).collect()} == {"a": (0, 0, None, None), "b": (0, 0, None, None)}
    assert learned_rules(empty) == {}
    with pytest.raises(ValueError, match="no numeric or text column"):
        column_sketches(spark.range(1).select(F.array(F.lit(1)).alias("a")))


def meant(text, names):
    """The name a text means, by trying every name."""
    if text in names:
        return text
    inside = [n for n in names if n in text]
    if inside:
        return min(inside, key=lambda n: (-len(n), n))
    return min((n for n in names if text in n), key=lambda n: (len(n), n), default=None)


def test_loose_names_against_trying_every_name(spark):
    rng = random.Random(3)
    word = lambda least, most: "".join(rng.choice("ab ") for _ in range(rng.randint(least, most))).strip()
    names, texts = {word(1, 7) for _ in range(25)} - {""}, {word(1, 14) for _ in range(150)} - {""} | {"zz", "é"}
    found = N.resolve_names(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {r.text: r.name for r in found.collect()} == {t: m for t in texts if (m := meant(t, names))}
    nothing = spark.createDataFrame([], "name string")
    assert N.resolve_names(found.select("text"), nothing).count() == 0


def test_profiles_fall_back_in_order(spark):
    profiles = spark.createDataFrame([("Retail", "us", 1), ("retail", None, 2), (None, "IN", 3), ("generic", "GLOBAL", 4), ("rail", "GB", 5)], "industry string, country string, rate int")
    rows = [(1, "US", "RETAIL "), (2, "in", "retail trade"), (3, "IN", "mines"), (4, None, None), (5, "GB", "rail"), (6, "US", "rail"), (7, " us ", "ret"), (8, "GB", ""), (9, "IN", None)]
    df = spark.createDataFrame(rows, "id int, country string, industry string")
    got = N.with_profile_table(df, profiles, "country", "industry", "id")
    assert got.columns == ["id", "country", "industry", "industry_key", "rate"]
    assert {r.id: (r.industry_key, r.rate) for r in got.collect()} == {
        1: ("retail", 1), 2: ("retail", 2), 3: ("generic", 3), 4: ("generic", 4), 5: ("rail", 5), 6: ("rail", 4), 7: ("retail", 1), 8: ("generic", 4), 9: ("generic", 3)}
    assert N.with_profile_table(df.limit(0), profiles, "country", "industry", "id").count() == 0
    assert [r.rate for r in N.with_profile_table(df, profiles.filter("rate = 5"), "country", "industry", "id").orderBy("id").collect()] == [None] * 4 + [5] + [None] * 4
    with pytest.raises(ValueError, match="several profiles"):
        N.with_profile_table(df, profiles.union(profiles), "country", "industry", "id")
    with pytest.raises(ValueError, match="in the table already"):
        N.with_profile_table(df.withColumn("rate", F.lit(1)), profiles, "country", "industry", "id")


def test_stretches_that_no_name_equals_are_dropped_before_they_are_moved(spark):
    names = spark.range(300).select(F.concat(F.lit("name "), "id").alias("name"))
    texts = spark.range(3000).select(F.concat(F.lit("name "), "id").alias("text"))
    pieces = N._pieces(texts, "text", 6, 8)
    passed = N._among(pieces, names, "name")
    assert passed.columns == pieces.columns
    want = pieces.join(names, pieces["piece"] == names["name"], "left_semi").count()
    assert passed.join(names, passed["piece"] == names["name"], "left_semi").count() == want
    assert want <= passed.count() < want + 0.05 * pieces.count()
