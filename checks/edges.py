"""Edge cases: how many, where, how rows are made to meet or to avoid them."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.generators import BALANCE, PLAN, SUBSCRIBER, SUBSCRIBER_SQL
from checks.registry import PORTABLE, query, table
from tablesmith.operators import edgecases as E
from tablesmith.operators import views as W
from tablesmith.operators.clearing import clear_cases
from tablesmith.operators.synthesize import synthesize
from tablesmith.spec import ColumnSpec, EdgeCase, Spec

KEY, SHARE = "c_custkey", 0.04
COUNT = f"SELECT count(*) AS n, CAST(floor(count(*) * {SHARE}::DOUBLE + 1e-12::DOUBLE) AS BIGINT) AS k FROM customer"
# Planted rows: rank i sits at row floor((i + 0.5) * n / k).
PICKS = f"SELECT range AS i, ((2 * range + 1) * n) // (2 * k) AS c_custkey FROM ({COUNT}), range((SELECT k FROM ({COUNT})))"

SEGMENT = ColumnSpec("c_mktsegment", "categorical", "weighted_choice", {"choices": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]})
NATION = ColumnSpec("c_nationkey", "int", "int_range", {"min": 0, "max": 24})
MONEY = ColumnSpec("c_acctbal", "float", "uniform", {"min": -1000, "max": 10000})
COLUMNS = (SEGMENT, NATION, MONEY)
NAMES = ["c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"]


def value(name: str, v, dtype: str) -> ColumnSpec:
    return ColumnSpec(name, dtype, "constant", {"value": v})


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(*NAMES)


def planted(spark, sf_dir, *cases: EdgeCase, columns=COLUMNS, base=None):
    base = customers(spark, sf_dir) if base is None else base
    spec = Spec(tuple(columns), edge_cases=cases, edge_fraction=SHARE)
    return E.plant(base, KEY, spec, PORTABLE, index=KEY)


def planted_sql(n_cases: int, changes: dict[str, list[str]], names: list[str], extra: str = "") -> str:
    """changes: column -> its new value per case (the column name itself where a case leaves it)."""
    select = ["c.c_custkey"]
    for column in NAMES[1:]:
        if column in changes:
            arms = " ".join(f"WHEN p.i % {n_cases} = {i} THEN {v}" for i, v in enumerate(changes[column]))
            select.append(f"CASE {arms} ELSE c.{column} END AS {column}")
        else:
            select.append(f"c.{column}")
    labels = " ".join(f"WHEN p.i % {n_cases} = {i} THEN '{n}'" for i, n in enumerate(names))
    return (f"SELECT {', '.join(select)}, CASE {labels} END AS edge_case_name, p.i IS NOT NULL AS is_edge_case{extra} "
            f"FROM customer c LEFT JOIN ({PICKS}) p ON c.c_custkey = p.c_custkey")


@query("edge_case_count", f"SELECT n AS total, k AS target FROM ({COUNT})")
def edge_case_count(spark, sf_dir):
    total = table(spark, sf_dir, "customer").agg(F.count("*").alias("total"))
    return total.withColumn("target", F.lit(E.edge_count(total.first().total, SHARE)).cast("bigint"))


@query("edge_case_positions", f"SELECT c.c_custkey, p.i AS position FROM customer c LEFT JOIN ({PICKS}) p ON c.c_custkey = p.c_custkey")
def edge_case_positions(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(KEY)
    total = customer.count()
    return customer.withColumn("position", E.spread_position(F.col(KEY), total, E.edge_count(total, SHARE)))


@query("edge_case_round_robin", f"SELECT CASE i % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS edge_case_name, c_custkey FROM ({PICKS})")
def edge_case_round_robin(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(KEY)
    total = customer.count()
    position = E.spread_position(F.col(KEY), total, E.edge_count(total, SHARE))
    cases = tuple(EdgeCase(n, "True") for n in "abc")
    return customer.withColumn("edge_case_name", E.case_name(position, cases)).filter("edge_case_name IS NOT NULL")


@query("edge_case_overrides", planted_sql(
    2, {"c_acctbal": ["0.0", S.cents(9000, 9500, "c_acctbal#high", "c.c_custkey")], "c_mktsegment": ["c.c_mktsegment", "'BUILDING'"]}, ["zero", "high"]))
def edge_case_overrides(spark, sf_dir):
    high = (ColumnSpec("c_acctbal", "float", "uniform", {"min": 9000, "max": 9500}), value("c_mktsegment", "BUILDING", "categorical"))
    return planted(spark, sf_dir, EdgeCase("zero", "c_acctbal == 0", (value("c_acctbal", 0, "float"),)), EdgeCase("high", 'c_mktsegment == "building"', high))


@query("edge_case_assignment", planted_sql(
    8, {"c_acctbal": ["12.5", "101.0", "5.01", "-50.0", "c.c_acctbal", "c.c_acctbal", "c.c_acctbal", "7.0"],
        "c_nationkey": ["c.c_nationkey", "c.c_nationkey", "c.c_nationkey", "2", "c.c_nationkey", "4", "c.c_nationkey", "c.c_nationkey"],
        "c_mktsegment": ["c.c_mktsegment", "c.c_mktsegment", "c.c_mktsegment", "c.c_mktsegment", "'FURNITURE'", "'BUILDING'", "'BUILDING'", "c.c_mktsegment"]},
    ["equal", "above", "above_decimal", "at_most", "member", "excluded", "not_equal", "either"]))
def edge_case_assignment(spark, sf_dir):
    return planted(
        spark, sf_dir, EdgeCase("equal", "c_acctbal == 12.5"), EdgeCase("above", "c_acctbal > 100"), EdgeCase("above_decimal", "c_acctbal > 5.0"),
        EdgeCase("at_most", "c_acctbal <= -50 and c_nationkey < 3"), EdgeCase("member", 'c_mktsegment in ["furniture", "machinery"]'),
        EdgeCase("excluded", 'c_mktsegment not in ["AUTOMOBILE"] and c_nationkey >= 4'), EdgeCase("not_equal", 'c_mktsegment != "automobile"'),
        EdgeCase("either", 'c_acctbal == 1 and c_acctbal == 2 or c_acctbal == 7'))


@query("edge_case_negation", planted_sql(
    3, {"c_acctbal": ["200.0", "c.c_acctbal", "c.c_acctbal"], "c_nationkey": ["c.c_nationkey", "9", "11"],
        "c_mktsegment": ["'BUILDING'", "c.c_mktsegment", "c.c_mktsegment"]}, ["not_low", "not_other", "not_either"]))
def edge_case_negation(spark, sf_dir):
    return planted(
        spark, sf_dir, EdgeCase("not_low", 'not c_acctbal < 200 and not c_mktsegment == "AUTOMOBILE"'), EdgeCase("not_other", "not c_nationkey != 9"),
        EdgeCase("not_either", "not (c_nationkey <= 10 or c_nationkey > 11)"))


DERIVED = (*COLUMNS, ColumnSpec("doubled", "float", "formula", formula="c_acctbal * 2"), ColumnSpec("total", "float", "formula", formula="doubled + c_nationkey"))
BALANCE_AFTER = "CASE WHEN p.i % 2 = 0 THEN 0.0 WHEN p.i % 2 = 1 THEN 9000.0 ELSE c.c_acctbal END"


@query("edge_case_formulas", planted_sql(
    2, {"c_acctbal": ["0.0", "9000.0"]}, ["zero", "high"],
    f", ({BALANCE_AFTER}) * 2.0::DOUBLE AS doubled, ({BALANCE_AFTER}) * 2.0::DOUBLE + c.c_nationkey::DOUBLE AS total"))
def edge_case_formulas(spark, sf_dir):
    base = customers(spark, sf_dir).withColumn("doubled", F.col("c_acctbal") * 2).withColumn("total", F.col("doubled") + F.col("c_nationkey"))
    cases = EdgeCase("zero", "c_acctbal == 0 and doubled == 0"), EdgeCase("high", "c_acctbal >= 9000 and total > 17000")
    return planted(spark, sf_dir, *cases, columns=DERIVED, base=base)


@query("edge_case_labels", f"SELECT n AS total_records, k AS edge_cases, k AS satisfied FROM ({COUNT})")
def edge_case_labels(spark, sf_dir):
    made = planted(spark, sf_dir, EdgeCase("zero", "c_acctbal == 0"), EdgeCase("high", "c_acctbal >= 9999 and c_nationkey in [1]"))
    holds = (F.col("c_acctbal") == 0) | ((F.col("c_acctbal") >= 9999) & (F.col("c_nationkey") == 1))
    return made.agg(F.count("*").alias("total_records"), F.count_if("is_edge_case").alias("edge_cases"),
                    F.count_if(F.col("is_edge_case") & holds).alias("satisfied"))


LINES = (ColumnSpec("l_discount", "float"), ColumnSpec("l_tax", "float"), ColumnSpec("l_linenumber", "int", "int_range", {"min": 1, "max": 7}),
         ColumnSpec("l_quantity", "float", "uniform", {"min": 1, "max": 50}))
LINE_CASES = (EdgeCase("tax_above", "l_discount < l_tax"), EdgeCase("discount_above", "l_discount >= l_tax"), EdgeCase("same", "l_discount == l_tax"),
              EdgeCase("apart", "l_discount != l_tax"), EdgeCase("bounds", "l_linenumber < l_quantity"))


@query("edge_case_field_pairs", """
    SELECT l_orderkey, l_linenumber AS line, c AS edge_case_name, true AS is_edge_case,
           CASE WHEN c = 'discount_above' THEN greatest(l_discount, l_tax) WHEN c = 'same' THEN l_tax
                WHEN c = 'apart' AND l_discount = l_tax THEN l_tax + 0.01::DOUBLE ELSE l_discount END AS l_discount,
           CASE WHEN c = 'tax_above' THEN greatest(l_tax, l_discount + 0.01::DOUBLE) ELSE l_tax END AS l_tax,
           CASE WHEN c = 'bounds' THEN 1 ELSE l_linenumber END AS l_linenumber, CASE WHEN c = 'bounds' THEN 50.0 ELSE l_quantity END AS l_quantity
    FROM (SELECT *, CASE l_orderkey % 5 WHEN 0 THEN 'tax_above' WHEN 1 THEN 'discount_above' WHEN 2 THEN 'same' WHEN 3 THEN 'apart' ELSE 'bounds' END AS c FROM lineitem)""")
def edge_case_field_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), "l_discount", "l_tax", "l_linenumber", "l_quantity")
    named = lines.withColumn("edge_case_name", E.case_name(F.col("l_orderkey"), LINE_CASES))
    return E.apply_cases(named, Spec(LINES, edge_cases=LINE_CASES), PORTABLE, "l_orderkey")


def at(column_sql: str, k: str) -> str:
    """Draw SQL for attempt k, a column."""
    return column_sql.replace("'0')", f"CAST({k} AS VARCHAR))")


PLAN_AT = at(S.choice(["'prepaid'", "'postpaid'"], [0.7, 0.3], "plan_type", KEY), "k")
BALANCE_AT = at(S.cents(0, 500, "balance", KEY), "k")
NORMAL = Spec((SUBSCRIBER, BALANCE, PLAN), edge_fraction=SHARE,
              edge_cases=(EdgeCase("postpaid", 'plan_type == "postpaid"'), EdgeCase("low", "balance < 100 and plan_type == 'prepaid'")))


@query("normal_rows_redrawn", f"""
    SELECT c_custkey, {SUBSCRIBER_SQL} AS subscriber_id, arg_min(balance, k) AS balance, arg_min(plan_type, k) AS plan_type
    FROM (SELECT c_custkey, k, {BALANCE_AT} AS balance, {PLAN_AT} AS plan_type FROM customer, range(20) AS r(k))
    WHERE NOT (plan_type = 'postpaid' OR balance < 100) GROUP BY c_custkey""")
def normal_rows_redrawn(spark, sf_dir):
    return E.synthesize_normal(table(spark, sf_dir, "customer").select(KEY), KEY, NORMAL, PORTABLE)


EVENT_SPEC = Spec(
    (ColumnSpec("value", "float", "uniform", {"min": 0, "max": 100}), ColumnSpec("user_id", "int")),
    edge_cases=(EdgeCase("free purchase", "value == 0 and user_id < 90", event_type="purchase"), EdgeCase("dear click", "value >= 500", event_type="click")))
TARGET = 137


@query("eligible_rows_picked", f"""
    WITH able AS (
        SELECT event_id, c, row_number() OVER (ORDER BY event_id) - 1 AS index, count(*) OVER () AS n
        FROM (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'free purchase' ELSE 'dear click' END AS c FROM events WHERE event_type IN ('purchase', 'click'))),
    picked AS (SELECT event_id, c FROM able JOIN (SELECT DISTINCT ((2 * range + 1) * n) // (2 * {TARGET}) AS index FROM range({TARGET}), (SELECT max(n) AS n FROM able)) USING (index))
    SELECT e.event_id, e.event_type, CASE WHEN c = 'free purchase' THEN 0.0 WHEN c = 'dear click' THEN 500.0 ELSE value END AS value,
           CASE WHEN c = 'free purchase' THEN 89 ELSE user_id END AS user_id, c AS edge_case_name, c IS NOT NULL AS is_edge_case
    FROM events e LEFT JOIN picked p ON e.event_id = p.event_id""")
def eligible_rows_picked(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")
    return E.plant_among_eligible(events, "event_id", EVENT_SPEC, PORTABLE, TARGET, "event_id")


CLEAR = Spec(COLUMNS, edge_cases=(EdgeCase("rich builder", 'c_acctbal >= 5000 and c_mktsegment == "BUILDING"'), EdgeCase("nation", "c_nationkey in [3, 4]")))


@query("normal_rows_unmatched", """
    SELECT c_custkey, CASE WHEN rich AND nation THEN 'AUTOMOBILE' ELSE c_mktsegment END AS c_mktsegment,
           CASE WHEN nation AND c_nationkey = 3 THEN 2 WHEN nation THEN 5 ELSE c_nationkey END AS c_nationkey,
           CASE WHEN rich AND (nation OR c_acctbal - 1 < 5000) THEN c_acctbal - 1 WHEN rich THEN -1000.0 ELSE c_acctbal END AS c_acctbal
    FROM (SELECT *, c_acctbal >= 5000 AND c_mktsegment = 'BUILDING' AS rich, c_nationkey IN (3, 4) AS nation FROM customer)""")
def normal_rows_unmatched(spark, sf_dir):
    return E.unmatch(customers(spark, sf_dir), CLEAR, label=None)


WIDE = [f"f{k}" for k in range(1, 13)]
#: The digits of twelve fields; the cases share f5 and f8.
WIDE_DIGITS = {name: 6 * k * k + 5 * k + 1 for k, name in enumerate(WIDE, 1)}
WIDE_CASES = tuple(EdgeCase(n, " and ".join(f"{f} >= 2" for f in WIDE[a:b])) for n, a, b in (("low", 0, 5), ("middle", 4, 8), ("high", 7, 12)))


@query("normal_rows_unmatched_wide", f"""
    WITH d AS (SELECT l_orderkey, l_linenumber, {', '.join(f'(l_orderkey * 7 + l_linenumber * {m} + l_partkey) % 11 AS {n}' for n, m in WIDE_DIGITS.items())} FROM lineitem),
    m AS (SELECT l_orderkey, l_linenumber, {', '.join(f"({' AND '.join(f'{f} >= 2' for f in WIDE[a:b])}) AS {n}" for n, a, b in (("low", 0, 5), ("middle", 4, 8), ("high", 7, 12)))} FROM d)
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN low AND high THEN 2 WHEN low OR middle OR high THEN 1 ELSE 0 END AS INTEGER) AS changed, false AS met FROM m""")
def normal_rows_unmatched_wide(spark, sf_dir):
    """Three overlapping cases on twelve fields: one shared field clears two cases, and no row changes more fields than it must."""
    lines = table(spark, sf_dir, "lineitem")
    digits = [((F.col("l_orderkey") * 7 + F.col("l_linenumber") * m + F.col("l_partkey")) % 11).alias(n) for n, m in WIDE_DIGITS.items()]
    rows = lines.select("l_orderkey", "l_linenumber", *digits)
    rows = rows.withColumn("before", F.array(*WIDE))
    spec = Spec(tuple(ColumnSpec(n, "int", "int_range", {"min": 0, "max": 10}) for n in WIDE), edge_cases=WIDE_CASES)
    changed = sum((F.get("before", k) != F.col(n)).cast("int") for k, n in enumerate(WIDE))
    met = F.greatest(*[F.expr(c.condition) for c in WIDE_CASES])
    return clear_cases(rows, spec, None).select("l_orderkey", "l_linenumber", changed.cast("int").alias("changed"), met.alias("met"))


TIMES = (ColumnSpec("ts", "datetime"), ColumnSpec("seen", "datetime"), ColumnSpec("done", "datetime"), ColumnSpec("day", "date"))
TIME_CASES = (EdgeCase("late", "ts > '2030-01-01T00:00:00'"), EdgeCase("chain", "ts < seen and seen < done"),
              EdgeCase("window", "seen >= '2024-03-01' and seen < done and done <= '2024-03-02 12:00:00'"), EdgeCase("early day", "day <= '2023-12-31' and day < ts"),
              EdgeCase("other time", "seen == done and done >= ts"))
TIME_ROWS = """SELECT event_id, ts, CASE WHEN event_id % 3 <> 0 THEN ts - to_days(CAST(event_id % 5 AS INTEGER)) END AS seen,
                      ts + to_hours(CAST(event_id % 7 - 3 AS INTEGER)) AS done, CAST(ts AS DATE) AS day, event_id % 5 AS c FROM events"""
LATER = "+ to_seconds(1)"


@query("edge_case_times", f"""
    WITH r AS ({TIME_ROWS}),
    a AS (SELECT *, CASE c WHEN 0 THEN greatest(ts, TIMESTAMP '2030-01-01 00:00:01') ELSE ts END AS ts1,
                 CASE c WHEN 1 THEN greatest(coalesce(seen, ts), ts {LATER})
                        WHEN 2 THEN greatest(least(coalesce(seen, done), TIMESTAMP '2024-03-02 11:59:59'), TIMESTAMP '2024-03-01 00:00:00')
                        WHEN 4 THEN greatest(coalesce(seen, done), ts) ELSE seen END AS seen1,
                 CASE c WHEN 3 THEN least(CAST(day AS TIMESTAMP), TIMESTAMP '2023-12-31 00:00:00') ELSE CAST(day AS TIMESTAMP) END AS day1 FROM r)
    SELECT event_id, CASE c WHEN 3 THEN greatest(ts1, day1 {LATER}) ELSE ts1 END AS ts, seen1 AS seen,
           CASE c WHEN 1 THEN greatest(done, seen1 {LATER}) WHEN 2 THEN greatest(least(done, TIMESTAMP '2024-03-02 12:00:00'), seen1 {LATER}) WHEN 4 THEN seen1 ELSE done END AS done,
           CAST(day1 AS DATE) AS day, true AS is_edge_case FROM a""")
def edge_case_times(spark, sf_dir):
    """Conditions on times: a literal, a chain of three columns, a window, a date beside a timestamp, and equal times."""
    i, ts = F.col("event_id"), F.col("ts")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.when(i % 3 != 0, F.timestamp_add("DAY", -(i % 5).cast("int"), ts)).alias("seen"),
                                                 F.timestamp_add("HOUR", (i % 7 - 3).cast("int"), ts).alias("done"), ts.cast("date").alias("day"))
    named = rows.withColumn("edge_case_name", E.case_name(i, TIME_CASES))
    return E.apply_cases(named, Spec(TIMES, edge_cases=TIME_CASES), PORTABLE, "event_id").drop("edge_case_name")


CHAIN = (ColumnSpec("l_discount", "float"), ColumnSpec("l_tax", "float"), ColumnSpec("l_linenumber", "int"), ColumnSpec("l_quantity", "float"))
CHAIN_CASES = (EdgeCase("rising", "l_discount < l_tax and l_tax < l_linenumber and l_linenumber <= l_quantity"), EdgeCase("boxed", "l_quantity >= l_linenumber and l_linenumber > 5 and l_quantity < 9"))


@query("edge_case_chains", """
    WITH a AS (SELECT l_orderkey, l_linenumber AS line, l_orderkey % 2 AS c, l_discount, l_quantity, l_linenumber,
                      CASE WHEN l_orderkey % 2 = 0 THEN greatest(l_tax, l_discount + 0.01::DOUBLE) ELSE l_tax END AS l_tax FROM lineitem),
    b AS (SELECT * EXCLUDE (l_linenumber), CAST(CASE c WHEN 0 THEN ceil(greatest(l_linenumber, l_tax + 0.01::DOUBLE)) ELSE greatest(least(l_linenumber, 8), 6) END AS BIGINT) AS l_linenumber FROM a)
    SELECT l_orderkey, line, l_discount, l_tax, l_linenumber, CASE c WHEN 0 THEN greatest(l_quantity, l_linenumber) ELSE greatest(least(l_quantity, 8), l_linenumber, 6) END AS l_quantity, true AS is_edge_case FROM b""")
def edge_case_chains(spark, sf_dir):
    """Four numbers in a row, and two columns that hold each other between literals."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), "l_discount", "l_tax", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity")
    named = lines.withColumn("edge_case_name", E.case_name(F.col("l_orderkey"), CHAIN_CASES))
    return E.apply_cases(named, Spec(CHAIN, edge_cases=CHAIN_CASES), PORTABLE, "l_orderkey").drop("edge_case_name")


REPAIR_CASES = (EdgeCase("zero", "c_acctbal == 0"), EdgeCase("home", 'c_mktsegment == "HOUSEHOLD" and c_nationkey > 20'))


@query("labelled_rows_repaired", """
    SELECT c_custkey, c_name AS edge_case_name, c_name IS NOT NULL AS is_edge_case, CASE WHEN c_name = 'zero' THEN 0.0 ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_name = 'home' THEN 'HOUSEHOLD' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_name = 'home' THEN 21 ELSE c_nationkey END AS c_nationkey
    FROM (SELECT * EXCLUDE (c_name), CASE c_custkey % 9 WHEN 0 THEN 'zero' WHEN 5 THEN 'home' END AS c_name FROM customer)""")
def labelled_rows_repaired(spark, sf_dir):
    slot = F.col(KEY) % 9
    stored = customers(spark, sf_dir).withColumn("edge_case_name", F.when(slot == 0, "zero").when(slot == 5, "home"))
    return E.apply_cases(stored, Spec(COLUMNS, edge_cases=REPAIR_CASES), PORTABLE, KEY)


@query("boundary_rows", """
    SELECT p_partkey, p_size, p_retailprice, array_to_string(list_filter([CASE WHEN p_size = s THEN 'p_size' ELSE '' END, CASE WHEN p_retailprice = r THEN 'p_retailprice' ELSE '' END], lambda x: x <> ''), '; ') AS at_boundary
    FROM part, (SELECT max(p_size) AS s, max(p_retailprice) AS r FROM part) WHERE p_size = s OR p_retailprice = r""")
def boundary_rows(spark, sf_dir):
    rows = E.boundary_rows(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return rows.withColumn("at_boundary", F.concat_ws("; ", "at_boundary"))


@query("label_totals", f"SELECT n AS total_records, k AS edge_cases FROM ({COUNT})")
def label_totals(spark, sf_dir):
    return W.label_totals(planted(spark, sf_dir, EdgeCase("zero", "c_acctbal == 0")))
