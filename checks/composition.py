"""Scans, projections, dependency closure, constraints, fan-out and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.generators import BALANCE, BALANCE_SQL, PLAN, PLAN_SQL, SUBSCRIBER, SUBSCRIBER_SQL, prefixed
from checks.registry import AS_OF, PORTABLE, SEED, query, table
from tablesmith.operators import journeys as J
from tablesmith.operators import views as W
from tablesmith.operators.profiling import learned_rules, profile_columns, profile_constraints
from tablesmith.operators.quality import drop_undeclared
from tablesmith.operators.synthesize import (Settings, add_formulas, constrain, synthesize,
                                             synthesize_range)
from tablesmith.functions.draws import Draws
from tablesmith.session import shared_folder
from tablesmith.sources.sink import write_records
from tablesmith.spec import ColumnSpec, EventSpec, Spec, declared_constraints, formula_table, with_rule_formulas

KEY = "c_custkey"
ACCOUNTS = Spec((SUBSCRIBER, BALANCE, PLAN))


@query("synthesize_range", f"""
    SELECT range AS unit_id, {prefixed('SUB-', 8, 'subscriber_id', 'range')} AS subscriber_id,
           {S.cents(0, 500, 'balance', 'range')} AS balance, {S.choice(["'prepaid'", "'postpaid'"], [0.7, 0.3], 'plan_type', 'range')} AS plan_type
    FROM range((SELECT count(*) FROM customer))""")
def run_synthesize_range(spark, sf_dir):
    return synthesize_range(spark, table(spark, sf_dir, "customer").count(), ACCOUNTS, PORTABLE)


@query("synthesize_keyed_table", f"""
    SELECT c_custkey, c_mktsegment, {SUBSCRIBER_SQL} AS subscriber_id, {BALANCE_SQL} AS balance, {PLAN_SQL} AS plan_type FROM customer""")
def run_synthesize(spark, sf_dir):
    return synthesize(table(spark, sf_dir, "customer").select(KEY, "c_mktsegment"), KEY, ACCOUNTS, PORTABLE)


EVENT_COLUMNS = Spec((ColumnSpec("value", "float"), ColumnSpec("user_id", "int"), ColumnSpec("props", "string")),
                     events=(EventSpec("click", 1, ("value",)),))


@query("ordered_projection", "SELECT event_type, ts AS event_timestamp, value, user_id, props, value > 50 AS is_edge_case FROM events")
def run_ordered_projection(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("ts", "event_timestamp").withColumn("is_edge_case", F.col("value") > 50)
    return W.ordered_projection(events, EVENT_COLUMNS)


@query("drop_undeclared", "SELECT o_orderkey, o_orderstatus FROM orders")
def run_drop_undeclared(spark, sf_dir):
    spec = Spec((ColumnSpec("o_orderkey", "int"), ColumnSpec("o_orderstatus"), ColumnSpec("not_there")))
    return drop_undeclared(table(spark, sf_dir, "orders"), spec)


@query("write_records", "SELECT event_id, event_type, ts, user_id, value FROM events")
def run_write_records(spark, sf_dir):
    import uuid

    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id", "value")
    write_records(events, path)
    return spark.read.schema(events.schema).parquet(path)


CLOSURE = Spec((
    SUBSCRIBER, BALANCE, PLAN,
    ColumnSpec("fee", "float", "formula", formula="balance * 0.25"),
    ColumnSpec("after_fee", "float", "formula", formula="balance - fee", depends_on=("balance", "fee")),
))


@query("dependency_closure", f"SELECT c_custkey, {BALANCE_SQL} AS balance, {BALANCE_SQL} * 0.25::DOUBLE AS fee, {BALANCE_SQL} - {BALANCE_SQL} * 0.25::DOUBLE AS after_fee FROM customer")
def run_dependency_closure(spark, sf_dir):
    return synthesize(table(spark, sf_dir, "customer").select(KEY), KEY, CLOSURE, PORTABLE, fields=["after_fee"])


PAIR = (EventSpec("OPENED", 1, ("amount",), 1, 3), EventSpec("CLOSED", 2, ("amount", "fee"), 2, 4))
JOURNEY = Spec(entity_key="subscriber_id", events=PAIR, columns=(
    SUBSCRIBER, PLAN, ColumnSpec("amount", "float", "uniform", {"min": 10, "max": 90}),
    ColumnSpec("fee", "float", "formula", formula="amount * 0.5")))


def slots_sql(key: str = "c_custkey", source: str = "customer", events: tuple[EventSpec, ...] = PAIR) -> str:
    """Entity x event x occurrence rows with the gap before each."""
    parts = []
    for e in events:
        n = S.between(e.min_occurrences, e.max_occurrences, f"occurrences:{e.event_type}", key)
        gap = (f"(5 + (CAST('0x' || substr(md5('{SEED}|gap:{e.event_type}|' || CAST({key} AS VARCHAR) || '|' || CAST(i AS VARCHAR)), 1, 8)"
               f" AS BIGINT) * 296) // 4294967296)")
        parts.append(f"SELECT {key}, '{e.event_type}' AS event_type, {e.sequence} AS event_sequence, i AS event_occurrence, {gap} AS gap"
                     f" FROM {source}, range(1, {e.max_occurrences + 1}) AS r(i) WHERE i <= {n}")
    return " UNION ALL ".join(parts)


def clock_sql(events: tuple[EventSpec, ...] = PAIR) -> str:
    return f"SELECT *, sum(gap) OVER (PARTITION BY c_custkey ORDER BY event_sequence, event_occurrence) AS elapsed FROM ({slots_sql(events=events)})"


CLOCK = clock_sql()


@query("fan_out", f"SELECT c_custkey, event_type, event_sequence, event_occurrence FROM ({slots_sql()})")
def run_fan_out(spark, sf_dir):
    return J.fan_out(table(spark, sf_dir, "customer").select(KEY), KEY, PAIR, PORTABLE, clock=False)


@query("event_clock", f"SELECT c_custkey, event_type, event_sequence, event_occurrence, CAST(elapsed AS BIGINT) AS elapsed_seconds FROM ({CLOCK})")
def run_event_clock(spark, sf_dir):
    return J.fan_out(table(spark, sf_dir, "customer").select(KEY), KEY, PAIR, PORTABLE)


RECORD = "(CAST(c_custkey AS VARCHAR) || '|' || event_type || '|' || CAST(event_occurrence AS VARCHAR))"


def meta_sql(events: tuple[EventSpec, ...] = PAIR) -> str:
    return f"""
    SELECT *, {S.AS_OF} + to_seconds(CAST(elapsed AS BIGINT)) AS event_timestamp,
           'JRN-' || upper({S.hexes('journey_id', 'c_custkey')}) AS journey_id,
           upper({S.hexes('transaction_id', RECORD)}) AS own_digits FROM ({clock_sql(events)})"""


META = meta_sql()


@query("journey_metadata", f"""
    SELECT c_custkey, event_type, event_sequence, event_occurrence, event_timestamp, journey_id,
           'TXN-' || strftime(event_timestamp, '%Y%m%d') || '-' || own_digits AS transaction_id FROM ({META})""")
def run_journey_metadata(spark, sf_dir):
    rows = J.fan_out(table(spark, sf_dir, "customer").select(KEY), KEY, PAIR, PORTABLE)
    return J.with_metadata(rows, KEY, PORTABLE)


@query("entity_event_split", f"""
    SELECT c_custkey, event_type, event_occurrence, subscriber_id, plan_type, amount,
           CASE WHEN event_type = 'CLOSED' THEN amount * 0.5::DOUBLE END AS fee
    FROM (SELECT *, {SUBSCRIBER_SQL} AS subscriber_id, {PLAN_SQL} AS plan_type, {S.cents(10, 90, 'amount', RECORD)} AS amount FROM ({slots_sql()}))""")
def run_entity_event_split(spark, sf_dir):
    entities = J.entity_table(table(spark, sf_dir, "customer").select(KEY), KEY, JOURNEY, PORTABLE)
    rows = J.event_rows(entities, KEY, JOURNEY, PORTABLE)
    return rows.select(KEY, "event_type", "event_occurrence", "subscriber_id", "plan_type", "amount", "fee")


@query("distinct_entity_keys", f"SELECT count(DISTINCT k) AS keys, count(*) AS entities FROM (SELECT {SUBSCRIBER_SQL} AS k FROM customer)")
def run_distinct_entity_keys(spark, sf_dir):
    made = synthesize(table(spark, sf_dir, "customer").select(KEY), KEY, Spec((SUBSCRIBER,)), PORTABLE)
    return made.agg(F.countDistinct("subscriber_id").alias("keys"), F.count("*").alias("entities"))


PRIORITY = ColumnSpec("priority", "categorical", "constant")
NORM = S.canonical("o_orderpriority")


@query("constrain_values", f"""
    SELECT o_orderkey,
           CASE WHEN {NORM} = '1_urgent' THEN '1 Urgent' WHEN {NORM} = '4_not_specified' THEN '4-Not-Specified'
                ELSE {S.choice(["'1 Urgent'", "'4-Not-Specified'"], [1.0, 1.0], 'priority', 'o_orderkey').replace('1, 8', '25, 8')} END AS priority,
           {S.rounded('least(200000.0::DOUBLE, greatest(50000.5::DOUBLE, o_totalprice))')} AS price
    FROM orders""")
def run_constrain(spark, sf_dir):
    draws = Draws(SEED, "priority", F.col("o_orderkey"), 0, "portable")
    rule = {"preferred_values": "1 Urgent|4-Not-Specified"}
    price = ColumnSpec("price", "float")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", constrain(F.col("o_orderpriority"), PRIORITY, rule, draws.u32(3)).alias("priority"),
        constrain(F.col("o_totalprice"), price, {"min": 50000.5, "max": "200000"}, draws.u32(3)).alias("price"))


@query("rule_formula_override", "SELECT l_orderkey, l_linenumber, l_quantity * l_tax AS levy, l_quantity + 1.0::DOUBLE AS kept FROM lineitem")
def run_rule_formula(spark, sf_dir):
    spec = Spec((ColumnSpec("levy", "float", "uniform", {"min": 0, "max": 1}), ColumnSpec("kept", "float", "formula", formula="l_quantity + 1")))
    spec = with_rule_formulas(spec, {"levy": "l_quantity * l_tax", "kept": "l_quantity * 100"})
    base = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return synthesize(base, "l_orderkey", spec, PORTABLE).select("l_orderkey", "l_linenumber", "levy", "kept")


@query("profile_constraints", """
    SELECT 'p_size' AS field, min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi, NULL::VARCHAR AS value, NULL::BIGINT AS n FROM part
    UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice), NULL, NULL FROM part
    UNION ALL SELECT 'p_brand', NULL, NULL, p_brand, count(*) FROM part GROUP BY p_brand
    UNION ALL SELECT 'p_type', NULL, NULL, p_type, count(*) FROM part GROUP BY p_type""")
def run_profile_constraints(spark, sf_dir):
    return profile_constraints(table(spark, sf_dir, "part"), ["p_size", "p_retailprice", "p_brand", "p_type"])


TEXT_KINDS = " UNION ALL ".join(f"""
    SELECT '{c}' AS field, CASE WHEN count(DISTINCT {c}) <= 50 THEN 'choice' ELSE 'text' END AS kind, count(*) AS rows, count(*) - count({c}) AS nulls, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi,
           CASE WHEN count(DISTINCT {c}) <= 50 THEN count(DISTINCT {c}) END AS different, max(strlen({c})) AS longest FROM documents""" for c in ("text", "lang", "source"))


@query("profile_free_text", f"""{TEXT_KINDS} UNION ALL
    SELECT 'n_chars', 'number', count(*), count(*) - count(n_chars), min(n_chars), max(n_chars), NULL, NULL FROM documents""")
def run_profile_free_text(spark, sf_dir):
    """Texts are told from choices by sketches and never counted by value."""
    kinds, _ = profile_columns(table(spark, sf_dir, "documents"), ["text", "lang", "source", "n_chars"], max_choices=50)
    return kinds.select("field", "kind", "rows", "nulls", "lo", "hi", "different", "longest")


SEGMENTS = Spec((ColumnSpec("o_totalprice", "float", "uniform", {"min": 0, "max": 1e9}), ColumnSpec("o_orderpriority", "categorical", "constant", {"value": "none"})))


@query("learned_constraints", """
    SELECT o_orderkey, o_totalprice >= (SELECT min(o_totalprice) FROM orders) AND o_totalprice <= (SELECT max(o_totalprice) FROM orders) AS in_bounds,
           o_orderpriority IN (SELECT o_orderpriority FROM orders) AS listed FROM orders""")
def run_learned_constraints(spark, sf_dir):
    """Columns generated under the rules learned from the same table keep to its bounds and words."""
    orders = table(spark, sf_dir, "orders")
    rules = learned_rules(orders, ["o_totalprice", "o_orderpriority"])
    made = synthesize(orders.select("o_orderkey"), "o_orderkey", SEGMENTS, Settings(seed=SEED, as_of=AS_OF, mode="portable", constraints=rules))
    bounds, words = rules["o_totalprice"], rules["o_orderpriority"]["valid_values"]
    # Generated prices are rounded to cents after clamping, as declared ones are.
    inside = F.col("o_totalprice").between(F.lit(round(bounds["min"], 2)), F.lit(round(bounds["max"], 2)))
    return made.select("o_orderkey", inside.alias("in_bounds"), F.col("o_orderpriority").isin(words).alias("listed"))


@query("declared_constraints", f"""
    SELECT c_custkey, {S.rounded(f'least(300.0::DOUBLE, greatest(100.0::DOUBLE, {BALANCE_SQL}))')} AS balance, {PLAN_SQL} AS plan_type FROM customer""")
def run_declared_constraints(spark, sf_dir):
    rules = declared_constraints(Spec((BALANCE, PLAN)), {"balance": {"min": 100, "max": 300}})
    settings = Settings(seed=SEED, as_of=AS_OF, mode="portable", constraints=rules)
    return synthesize(table(spark, sf_dir, "customer").select(KEY), KEY, Spec((BALANCE, PLAN)), settings)


@query("formula_precedence", "SELECT l_orderkey, l_linenumber, l_quantity * 2.0::DOUBLE AS own, l_tax * 3.0::DOUBLE AS listed FROM lineitem")
def run_formula_precedence(spark, sf_dir):
    spec = Spec((ColumnSpec("own", "float", "formula", formula="l_quantity * 2"), ColumnSpec("listed", "float")))
    formulas = formula_table(spec, {"own": "l_quantity * 9", "listed": "l_tax * 3"})
    lines = table(spark, sf_dir, "lineitem")
    return add_formulas(lines, formulas).select("l_orderkey", "l_linenumber", "own", "listed")
