"""Conditions and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, table
from tablesmith.functions import expressions as X
from tablesmith.operators.synthesize import add_formulas
from tablesmith.spec import EdgeCase


def flags(df, keys, conditions: dict[str, str]):
    return df.select(*keys, *[X.matches(text, X.fields_of(df)).alias(name) for name, text in conditions.items()])


@query("condition_operators", """
    SELECT c_custkey,
           coalesce(c_acctbal > 0 AND (c_nationkey IN (1, 2, 3) OR NOT c_nationkey < 20), false) AS mixed,
           coalesce(c_acctbal BETWEEN -100 AND 100.5, false) AS chained,
           c_nationkey NOT IN (0, 5, 10) AS outside, c_nationkey <> 7 AS not_seven, c_nationkey = 3 AS same,
           c_acctbal IS NOT NULL AS known, c_acctbal < 5 AS mirrored, c_acctbal < -5 AS negative, c_nationkey <> 0 AS bare, true AS empty, false AS unreadable
    FROM customer""")
def condition_operators(spark, sf_dir):
    return flags(table(spark, sf_dir, "customer"), ["c_custkey"], {
        "mixed": "c_acctbal > 0 and (c_nationkey in [1, 2, 3] or not c_nationkey < 20)", "chained": "-100 <= c_acctbal <= 100.5",
        "outside": "c_nationkey not in (0, 5, 10)", "not_seven": "c_nationkey != 7", "same": "c_nationkey is 3",
        "known": "c_acctbal is not None", "mirrored": "5 > c_acctbal", "negative": "c_acctbal < -5", "bare": "c_nationkey",
        "empty": "", "unreadable": "c_acctbal.real > 0"})


@query("condition_numeric_text", """
    SELECT o_orderkey, coalesce(n > 250000, false) AS above, coalesce(n = 1, false) AS is_one, n IS NULL OR n <> 1 AS not_one
    FROM (SELECT o_orderkey, CASE WHEN x IN ('nan', 'inf') THEN NULL ELSE TRY_CAST(trim(x) AS DOUBLE) END AS n
          FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' ' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) || ' ' WHEN 1 THEN o_orderstatus
                WHEN 2 THEN 'nan' WHEN 3 THEN NULL WHEN 4 THEN '1.0' ELSE 'inf' END AS x FROM orders))""")
def condition_numeric_text(spark, sf_dir):
    slot = F.col("o_orderkey") % 6
    text = (F.when(slot == 0, F.concat(F.lit(" "), F.round("o_totalprice").cast("bigint").cast("string"), F.lit(" "))).when(slot == 1, F.col("o_orderstatus"))
            .when(slot == 2, "nan").when(slot == 3, None).when(slot == 4, "1.0").otherwise("inf"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("x"))
    return flags(orders, ["o_orderkey"], {"above": "x > 250000", "is_one": "x == 1", "not_one": "x != 1"})


@query("condition_boolean_text", """
    SELECT o_orderkey, coalesce(b, false) AS is_true, coalesce(NOT b, false) AS is_false, b IS NULL OR NOT b AS not_true
    FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN NULL ELSE false END AS b FROM orders)""")
def condition_boolean_text(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in (" YES", "off", "Enabled", "maybe", "0")])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(words, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("x"))
    return flags(orders, ["o_orderkey"], {"is_true": "x == True", "is_false": "x == False", "not_true": "x != True"})


@query("condition_text_case", """
    SELECT c_custkey, c_mktsegment = 'BUILDING' AS same, c_mktsegment IN ('MACHINERY', 'FURNITURE') AS member,
           c_mktsegment NOT IN ('BUILDING') AS other, c_mktsegment <> 'BUILDING' AS differs, c_mktsegment <= 'BUILDING' AS up_to
    FROM customer""")
def condition_text_case(spark, sf_dir):
    return flags(table(spark, sf_dir, "customer"), ["c_custkey"], {
        "same": 'c_mktsegment == " building "', "member": 'c_mktsegment in ["Machinery", "furniture"]',
        "other": 'c_mktsegment not in ["building"]', "differs": 'c_mktsegment != "Building"', "up_to": 'c_mktsegment <= "BUILDING"'})


@query("condition_null_rules", """
    SELECT o_orderkey, v IS NULL OR v <> 5 AS differs, v IS NULL OR v NOT IN (5, 6) AS outside, coalesce(v > 5, false) AS above,
           v IS NULL AS missing, coalesce(v > 5, false) OR o_orderkey % 2 = 0 AS either, false AS undeclared, false AS negated
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 10 END AS v FROM orders)""")
def condition_null_rules(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 3 != 0, key % 10).alias("v"), (key % 2).alias("odd"))
    return flags(orders, ["o_orderkey"], {
        "differs": "v != 5", "outside": "v not in [5, 6]", "above": "v > 5", "missing": "v is None", "either": "v > 5 or odd == 0",
        "undeclared": "o_orderkey >= 0 or nowhere == 1", "negated": "not v >= 0"})


CASES = (EdgeCase("rich", "c_acctbal >= 9000"), EdgeCase("segment", 'c_mktsegment == "building" and c_nationkey < 3'))


@query("condition_any_of", "SELECT c_custkey, c_acctbal >= 9000 OR (c_mktsegment = 'BUILDING' AND c_nationkey < 3) AS is_edge_case FROM customer")
def condition_any_of(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return customer.select("c_custkey", X.matches_any(CASES, X.fields_of(customer)).alias("is_edge_case"))


SCOPED = (EdgeCase("big purchase", "value > 50", event_type="purchase"), EdgeCase("any tiny", "value < 1"))


@query("condition_event_scope", "SELECT event_id, (event_type = 'purchase' AND value > 50) OR value < 1 AS is_edge_case FROM events")
def condition_event_scope(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", X.matches_any(SCOPED, X.fields_of(events), F.col("event_type")).alias("is_edge_case"))


LINE = ["l_orderkey", "l_linenumber"]


@query("formula_arithmetic", """
    SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1.0::DOUBLE - l_discount) * (1.0::DOUBLE + l_tax) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS charge,
           least(l_quantity, 10.0::DOUBLE, l_linenumber::DOUBLE) AS smallest, CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END AS ratio,
           abs(-l_quantity + 3.0::DOUBLE) AS away, l_quantity - floor(l_quantity / 7.0::DOUBLE) * 7.0::DOUBLE AS rest, l_quantity * l_quantity AS squared
    FROM lineitem""")
def formula_arithmetic(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    formulas = {"charge": "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2)", "smallest": "min(l_quantity, 10, l_linenumber)",
                "ratio": "l_quantity / l_tax", "away": "abs(-l_quantity + 3)", "rest": "l_quantity % 7", "squared": "l_quantity * l_quantity"}
    return add_formulas(lines, formulas).select(*LINE, *formulas)


@query("formula_fixpoint", """
    SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS cut, l_extendedprice - l_extendedprice * l_discount AS net,
           (l_extendedprice - l_extendedprice * l_discount) * (1.0::DOUBLE + l_tax) AS gross FROM lineitem""")
def formula_fixpoint(spark, sf_dir):
    formulas = {"gross": "net * (1 + l_tax)", "net": "l_extendedprice - cut", "cut": "l_extendedprice * l_discount"}
    return add_formulas(table(spark, sf_dir, "lineitem"), formulas).select(*LINE, "cut", "net", "gross")


@query("condition_field_to_field", """
    SELECT l_orderkey, l_linenumber, l_discount < l_tax AS below, l_discount = l_tax AS same, l_discount <> l_tax AS differs,
           l_quantity >= l_linenumber AS enough, l_returnflag = l_linestatus AS same_flag FROM lineitem""")
def condition_field_to_field(spark, sf_dir):
    return flags(table(spark, sf_dir, "lineitem"), LINE, {
        "below": "l_discount < l_tax", "same": "l_discount == l_tax", "differs": "l_discount != l_tax", "enough": "l_quantity >= l_linenumber",
        "same_flag": "l_returnflag == l_linestatus"})
