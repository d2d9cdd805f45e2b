"""End-to-end jobs over the test tables."""

from __future__ import annotations

import csv
import io
import json
import uuid

from pyspark.sql import functions as F

from checks import sql as S
from checks.edges import KEY, PICKS, at
from checks.composition import RECORD, meta_sql
from checks.generators import column_sql, prefixed
from checks.registry import PORTABLE, query, table
from checks.repairs import CHECK_LIST, report_row
from tablesmith.functions.profiles import Profile
from tablesmith.operators import views as W
from tablesmith.operators.edgecases import synthesize_normal
from tablesmith.operators.synthesize import synthesize
from tablesmith.plans.presets import account_sample, low_balance_catalog, recharge_sample
from tablesmith.plans.scenario import (Validation, generate_journeys, generate_records, kept_records, set_aside_records,
                                       validate, validate_to)
from tablesmith.session import shared_folder
from tablesmith.sources.definitions import load_spec
from tablesmith.spec import ColumnSpec, EdgeCase, Spec

HEADER = ["record_type", "name", "dtype", "description", "gen", "params", "depends_on", "nullable", "formula", "event_type", "sequence", "fields",
          "min_occurrences", "max_occurrences", "edge_case_name", "edge_case_description", "condition", "edge_case_percentage", "value"]


def definition_text(spec: Spec) -> str:
    """A spec as a definition file."""
    out = io.StringIO()
    writer = csv.DictWriter(out, HEADER, lineterminator="\n")
    writer.writeheader()

    def row(c) -> dict:
        return {"name": c.name, "dtype": c.dtype, "gen": c.gen, "params": json.dumps(c.params) if c.params else "", "depends_on": ";".join(c.depends_on),
                "nullable": str(c.nullable).lower(), "formula": c.formula or ""}

    for c in spec.columns:
        writer.writerow({"record_type": "variable", **row(c)})
    for e in spec.events:
        writer.writerow({"record_type": "event", "event_type": e.event_type, "sequence": e.sequence, "fields": ";".join(e.fields),
                         "min_occurrences": e.min_occurrences, "max_occurrences": e.max_occurrences})
    for case in spec.edge_cases:
        for o in case.overrides:
            writer.writerow({"record_type": "edge_case_variable", **row(o), "event_type": case.event_type or "", "edge_case_name": case.name, "condition": case.condition})
    writer.writerow({"record_type": "metadata", "name": "edgeCasePercentage", "value": spec.edge_fraction})
    return out.getvalue()


def stored_definition(spark, spec: Spec) -> str:
    """Put a definition where all executors can read it."""
    path = f"{shared_folder(spark)}/definition-{uuid.uuid4().hex}"
    lines = [(line,) for line in definition_text(spec).splitlines()]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    return path


STATUS = at(S.choice(["'ACTIVE'", "'SUSPENDED'", "'CLOSED'"], [0.8, 0.15, 0.05], "account_status", KEY), "k")
PLAN = at(S.choice(["'prepaid'", "'postpaid'"], [0.7, 0.3], "plan_type", KEY), "k")
BALANCE, SPEND = (at(S.cents(0, high, name, KEY), "k") for name, high in (("balance", 500), ("monthly_spend", 1000)))
RECORDS = f"""
    WITH drawn AS (SELECT c_custkey, k, {BALANCE} AS balance, {PLAN} AS plan_type, {STATUS} AS account_status, {SPEND} AS monthly_spend FROM customer, range(20) AS r(k)),
    normal AS (SELECT * FROM drawn WHERE NOT (balance = 0 OR monthly_spend >= 1000) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY k) = 1)
    SELECT c_custkey, {prefixed('SUB-', 8, 'subscriber_id')} AS subscriber_id, CASE WHEN i % 3 IN (0, 1) THEN 0.0 ELSE balance END AS balance, plan_type,
           CASE WHEN i % 3 = 1 THEN 'SUSPENDED' ELSE account_status END AS account_status, CASE WHEN i % 3 = 2 THEN 1000.0 ELSE monthly_spend END AS monthly_spend,
           CASE i % 3 WHEN 0 THEN 'ZERO_BALANCE_ACCOUNT' WHEN 1 THEN 'ZERO_BALANCE_SUSPENDED' WHEN 2 THEN 'HIGH_SPEND_OUTLIER' END AS edge_case_name, i IS NOT NULL AS is_edge_case
    FROM normal LEFT JOIN (SELECT c_custkey, i FROM ({PICKS})) USING (c_custkey)"""


def flat_records(spark, sf_dir, settings=PORTABLE):
    return generate_records(table(spark, sf_dir, "customer").select(KEY), KEY, account_sample(), settings, index=KEY)


@query("flat_records_job", RECORDS)
def flat_records_job(spark, sf_dir):
    return flat_records(spark, sf_dir)


@query("definition_driven_records", RECORDS)
def definition_driven_records(spark, sf_dir):
    """The same job from a definition file."""
    spec = load_spec(spark, stored_definition(spark, account_sample()))
    return generate_records(table(spark, sf_dir, "customer").select(KEY), KEY, spec, PORTABLE, index=KEY)


@query("flat_records_sparse_key", f"""
    SELECT c_custkey * 7 + 3 AS id, CASE i % 3 WHEN 0 THEN 'ZERO_BALANCE_ACCOUNT' WHEN 1 THEN 'ZERO_BALANCE_SUSPENDED' WHEN 2 THEN 'HIGH_SPEND_OUTLIER' END AS edge_case_name,
           i IS NOT NULL AS is_edge_case FROM customer LEFT JOIN ({PICKS}) USING (c_custkey)""")
def flat_records_sparse_key(spark, sf_dir):
    """Keys with gaps and no index: the job numbers the rows itself and still plants the exact share."""
    keys = table(spark, sf_dir, "customer").select((F.col(KEY) * 7 + 3).alias("id"))
    return generate_records(keys, "id", account_sample(), PORTABLE).select("id", "edge_case_name", "is_edge_case")


@query("normal_rows_changed", "SELECT count(*) AS records, 0 AS hits, count(*) AS in_bounds FROM customer")
def normal_rows_changed(spark, sf_dir):
    """A case that 98 of 100 draws meet: rows that every attempt hits are changed, and no row fails the job."""
    often = ColumnSpec("score", "float", "uniform", {"min": 0, "max": 100})
    made = synthesize_normal(table(spark, sf_dir, "customer").select(KEY), KEY, Spec((often,), edge_cases=(EdgeCase("often", "score >= 2"),), edge_fraction=0.01), PORTABLE)
    return made.agg(F.count("*").alias("records"), F.count_if(F.col("score") >= 2).cast("int").alias("hits"), F.count_if(F.col("score").between(0, 100)).alias("in_bounds"))


@query("validated_labels", "SELECT c_custkey, c_acctbal, c_acctbal < 0 AS is_edge_case FROM customer")
def validated_labels(spark, sf_dir):
    """Labelled rows without a case name that meet a case keep their values and their label."""
    spec = Spec((ColumnSpec(KEY, "int"), ColumnSpec("c_acctbal", "float")), edge_cases=(EdgeCase("low", "c_acctbal < 0"), EdgeCase("lower", "c_acctbal < -500")))
    rows = table(spark, sf_dir, "customer").select(KEY, "c_acctbal", (F.col("c_acctbal") < 0).alias("is_edge_case"))
    return validate(rows, spec, PORTABLE, Validation(key=KEY)).select(KEY, "c_acctbal", "is_edge_case")


# Every customer is labelled, rightly or not: those that meet no case are set aside.
ASIDE = Spec((ColumnSpec(KEY, "int"), ColumnSpec("c_acctbal", "float", "uniform", {"min": -500, "max": 9500})),
             edge_cases=(EdgeCase("low", "c_acctbal < 0"), EdgeCase("rich", "c_acctbal > 9000")))
ASIDE_SQL = f"""
    SELECT *, is_edge_case AND NOT (fixed < 0 OR fixed > 9000) AS set_aside FROM (
        SELECT c_custkey, c_acctbal, true AS is_edge_case, least(9500.0, greatest(-500.0, c_acctbal)) AS fixed FROM customer)"""


def labelled_customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(KEY, "c_acctbal", F.lit(True).alias("is_edge_case"))


def _validated_to(spark, sf_dir):
    path = f"{shared_folder(spark)}/validated-{uuid.uuid4().hex}"
    return path, validate_to(labelled_customers(spark, sf_dir), ASIDE, PORTABLE, path, Validation(key=KEY))


@query("validated_rows_set_aside", f"""
    SELECT c_custkey, fixed AS c_acctbal, is_edge_case, set_aside, array_to_string(list_filter([
        CASE WHEN set_aside THEN 'label: meets no edge case' ELSE '' END, CASE WHEN c_acctbal < -500 THEN 'c_acctbal: below its minimum' ELSE '' END,
        CASE WHEN c_acctbal > 9500 THEN 'c_acctbal: above its maximum' ELSE '' END], lambda x: x <> ''), '; ') AS issues FROM ({ASIDE_SQL})""")
def validated_rows_set_aside(spark, sf_dir):
    """A validation run writes valid rows and rows whose label is false into two folders; both are read back."""
    path, _ = _validated_to(spark, sf_dir)
    kept, aside = kept_records(spark, path), set_aside_records(spark, path)
    rows = kept.withColumn("set_aside", F.lit(False)).unionByName(aside.withColumn("set_aside", F.lit(True)))
    return rows.withColumn("issues", F.concat_ws("; ", "issues"))


@query("validation_report_while_writing", f"""
    SELECT count(*) AS total_input, count(*) FILTER (NOT set_aside) AS total_valid, count(*) FILTER (set_aside) AS total_dropped, 0 AS recovered,
           count(*) FILTER (NOT set_aside AND c_acctbal <> fixed) AS algo_fixes, {CHECK_LIST} AS deterministic_checks FROM ({ASIDE_SQL})""")
def validation_report_while_writing(spark, sf_dir):
    """The report of the same run, measured by the tasks that write it."""
    return _validated_to(spark, sf_dir)[1].withColumn("deterministic_checks", F.concat_ws("; ", "deterministic_checks"))


PAST_KEYS = "(SELECT o_orderkey * 2 + 9000000 - (SELECT max(o_orderkey) FROM orders) AS id FROM orders)"


@query("catalog_past_its_digits", f"""
    SELECT length(CAST(id + 1000000 AS VARCHAR)) AS digits, count(*) AS records, count(DISTINCT id) AS different FROM {PAST_KEYS} GROUP BY 1""")
def catalog_past_its_digits(spark, sf_dir):
    """Keys on both sides of a 7-digit id space, at any size of the table: ids stay unique and only the later ones are longer."""
    ids = Spec((ColumnSpec("subscriber", "string", "prefixed_int", {"prefix": "", "digits": 7}),))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    last = orders.agg(F.max("o_orderkey").alias("last"))
    keys = orders.join(F.broadcast(last), F.lit(True)).select((F.col("o_orderkey") * 2 + 9_000_000 - F.col("last")).alias("id"))
    made = synthesize(keys, "id", ids, PORTABLE)
    return made.groupBy(F.length("subscriber").cast("bigint").alias("digits")).agg(F.count("*").alias("records"), F.count_distinct("subscriber").alias("different"))


# Formulas of the catalog in SQL.
CATALOG_FORMULAS = {
    "low_balance_threshold_amt": S.rounded("least(15.0::DOUBLE, greatest(0.5::DOUBLE, avg_daily_spend_trailing_30d * (dynamic_lb_threshold_pct / 100.0::DOUBLE)))"),
    "recharge_amount": "recommended_topup_amt", "balance_after": S.rounded("balance_before + recharge_amount"),
}


def catalog_sql() -> str:
    """Nested selects, one per catalog column."""
    inner = "SELECT c_custkey FROM customer"
    for c in low_balance_catalog().columns:
        inner = f"SELECT *, {CATALOG_FORMULAS.get(c.name) or column_sql(c)} AS {c.name} FROM ({inner})"
    return inner


@query("full_catalog_job", catalog_sql())
def full_catalog_job(spark, sf_dir):
    """All 35 catalog columns on every customer."""
    return synthesize(table(spark, sf_dir, "customer").select(KEY), KEY, low_balance_catalog(), PORTABLE)


def journeys(spark, sf_dir, settings=PORTABLE):
    return generate_journeys(table(spark, sf_dir, "customer").select(KEY), KEY, recharge_sample(), settings)


EVENTS, SIZE = recharge_sample().events, sum(e.max_occurrences for e in recharge_sample().events)
DRAWN = {c.name: at(column_sql(c, RECORD), "k") for c in recharge_sample().columns if c.name in ("balance_before", "recharge_amount", "session_status", "payment_method_type")}
JOURNEYS = f"""
    WITH rows AS (SELECT *, {prefixed('SUB-', 8, 'subscriber_id')} AS subscriber_id, 'TXN-' || strftime(event_timestamp, '%Y%m%d') || '-' || own_digits AS transaction_id,
                         event_type = 'RECHARGE_COMPLETED' AS paid, c_custkey * {SIZE} + CASE event_type WHEN 'BALANCE_LOW' THEN 0 ELSE 3 END + event_occurrence - 1 AS row_id FROM ({meta_sql(EVENTS)})),
    drawn AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in DRAWN.items())} FROM rows, range(20) AS r(k)),
    normal AS (SELECT * FROM drawn WHERE NOT (paid AND ((balance_before = 0 AND session_status = 'TERMINATING') OR recharge_amount >= 500)) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY k) = 1),
    sizes AS (SELECT (SELECT count(*) FROM rows WHERE paid) AS n, (SELECT CAST(floor(count(*) * 0.02::DOUBLE + 1e-12::DOUBLE) AS BIGINT) FROM customer) AS t),
    picked AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS index FROM rows WHERE paid)
               JOIN (SELECT ((2 * range + 1) * n) // (2 * t) AS index FROM sizes, range((SELECT t FROM sizes))) USING (index)),
    final AS (SELECT normal.* EXCLUDE (balance_before, session_status), p.row_id IS NOT NULL AS is_edge_case, CASE WHEN p.row_id IS NOT NULL THEN 0.0 ELSE balance_before END AS balance_before,
                     CASE WHEN p.row_id IS NOT NULL THEN 'TERMINATING' ELSE session_status END AS session_status FROM normal LEFT JOIN picked p ON p.row_id = normal.row_id)
    SELECT journey_id, transaction_id, event_type, event_sequence, event_occurrence, event_timestamp, subscriber_id, balance_before, session_status, is_edge_case,
           CASE WHEN paid THEN recharge_amount END AS recharge_amount, CASE WHEN paid THEN balance_before + recharge_amount END AS balance_after,
           CASE WHEN paid THEN payment_method_type END AS payment_method_type FROM final"""


@query("journey_records_job", JOURNEYS)
def journey_records_job(spark, sf_dir):
    return W.ordered_projection(journeys(spark, sf_dir), recharge_sample())


@query("journey_labels_job", "SELECT CAST(floor(count(*) * 0.02::DOUBLE + 1e-12::DOUBLE) AS BIGINT) AS edge_cases, 0 AS wrong FROM customer")
def journey_labels_job(spark, sf_dir):
    """Labels over whole histories: the exact number, each on a matching event and on no other."""
    match = (F.col("event_type") == "RECHARGE_COMPLETED") & (((F.col("balance_before") == 0) & (F.col("session_status") == "TERMINATING")) | (F.col("recharge_amount") >= 500))
    return journeys(spark, sf_dir).agg(F.count_if("is_edge_case").alias("edge_cases"), F.count_if(F.col("is_edge_case") != F.coalesce(match, F.lit(False))).alias("wrong"))


@query("validated_records_job", f"""
    SELECT count(*) AS total_input, count(*) AS total_valid, 0 AS total_dropped, 0 AS recovered, 0 AS algo_fixes, {CHECK_LIST} AS deterministic_checks FROM customer""")
def validated_records_job(spark, sf_dir):
    """Freshly generated records pass validation without a single fix."""
    spec = account_sample()
    return report_row(validate(flat_records(spark, sf_dir), spec, PORTABLE))


@query("validated_journeys_job", "SELECT count(*) * 0 AS fixes_on_sound_rows, CAST(floor(count(*) * 0.02::DOUBLE + 1e-12::DOUBLE) AS BIGINT) AS edge_cases FROM customer")
def validated_journeys_job(spark, sf_dir):
    """Validation of whole histories keeps sound rows and all labels."""
    options = Validation(Profile(None, "telecom"), order="row_id", journeys=True)
    spec = recharge_sample()
    fixed = validate(journeys(spark, sf_dir).drop("payment_method_type"), spec, PORTABLE, options)
    return fixed.agg(F.sum(F.size("issues")).alias("fixes_on_sound_rows"), F.count_if("is_edge_case").alias("edge_cases"))


@query("nested_journeys_job", f"""
    SELECT subscriber_id, row_number() OVER (PARTITION BY subscriber_id ORDER BY event_type) - 1 AS position, event_type, count(*) AS total_count,
           string_agg(transaction_id, ' ' ORDER BY event_occurrence) AS transactions, string_agg(CAST(is_edge_case AS VARCHAR), ' ' ORDER BY event_occurrence) AS labels FROM ({JOURNEYS}) GROUP BY subscriber_id, event_type""")
def nested_journeys_job(spark, sf_dir):
    """Whole histories as entity documents, unfolded again for the check."""
    spec = recharge_sample()
    documents = W.nest(journeys(spark, sf_dir).drop(KEY), spec.entity_key, spec.events, "row_id")
    flat = documents.select("subscriber_id", F.posexplode("events").alias("position", "e"))
    return flat.select("subscriber_id", "position", F.col("e.event_type").alias("event_type"), F.col("e.totalCount").alias("total_count"),
                       F.concat_ws(" ", "e.records.transaction_id").alias("transactions"), F.concat_ws(" ", F.col("e.records.is_edge_case").cast("array<string>")).alias("labels"))
