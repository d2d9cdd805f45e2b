"""Record repairs on tables with faults derived from their keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import sql as S
from checks.generators import METHODS
from checks.registry import PORTABLE, SEED, query, table
from tablesmith.functions.profiles import Profile
from tablesmith.functions.values import first_match
from tablesmith.operators import edgecases as E
from tablesmith.operators import journeys as J
from tablesmith.operators import quality as Q
from tablesmith.plans.scenario import Validation, validate
from tablesmith.session import shared_folder
from tablesmith.spec import ColumnSpec, EdgeCase, EventSpec, Spec
from tablesmith.streaming.records import repair_stream, write_stream

CODES = ["US", "IN", "GB", "AE", "ZZ"]


def code_of(number):
    """Country code by a number modulo five."""
    return first_match([(number % 5 == i, F.lit(c)) for i, c in enumerate(CODES[:4])], F.lit("ZZ"))


def code_sql(number: str, arms: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {arms[c]}" for i, c in enumerate(CODES[:4]))
    return f"(CASE {number} % 5 {whens} ELSE {arms['ZZ']} END)"


LABELS = {"US": "'US'", "IN": "'IN'", "GB": "'GB'", "AE": "'AE'", "ZZ": "'GLOBAL'"}
WORDS = ["UPI", "Credit Card", "pay-pal", "ACH"]
WORD_SQL = "(CASE o_orderkey % 4 WHEN 0 THEN 'UPI' WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'pay-pal' ELSE 'ACH' END)"
ALLOWED = {c: "(" + ", ".join(S.texts(m)) + ")" for c, m in METHODS.items()}
FIRST = {c: f"'{m[0]}'" for c, m in METHODS.items()}
BAD_PAYMENT = code_sql("c_nationkey", {c: f"{S.canonical('payment_method')} NOT IN {ALLOWED[c]}" for c in CODES})


@query("repair_payment_methods", f"""
    SELECT o_orderkey, CASE WHEN bad THEN {code_sql('c_nationkey', FIRST)} ELSE payment_method END AS payment_method,
           CASE WHEN bad THEN 'payment_method: not used in country ' || {code_sql('c_nationkey', LABELS)} ELSE '' END AS issue
    FROM (SELECT *, {BAD_PAYMENT} AS bad FROM (SELECT o_orderkey, c_nationkey, {WORD_SQL} AS payment_method FROM orders JOIN customer ON o_custkey = c_custkey))""")
def repair_payment_methods(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", word.alias("payment_method"))
    fixed = Q.repair_country_values(orders.join(customers, "o_custkey"), Profile(code_of(F.col("c_nationkey")), "telecom"))
    return fixed.select("o_orderkey", "payment_method", F.concat_ws("; ", "issues").alias("issue"))


CURRENCY = {"US": "'USD'", "IN": "'INR'", "GB": "'GBP'", "AE": "'AED'", "ZZ": "'USD'"}


@query("repair_currencies", f"""
    SELECT c_custkey, CASE WHEN lower(trim(currency)) <> lower(own) THEN own ELSE currency END AS wallet_currency
    FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'inr' WHEN 1 THEN 'USD' END AS currency, {code_sql('n_nationkey', CURRENCY)} AS own
          FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def repair_currencies(spark, sf_dir):
    slot = F.col("c_custkey") % 3
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.when(slot == 0, "inr").when(slot == 1, "USD").alias("wallet_currency"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    fixed = Q.repair_country_values(customers.join(nations, "n_nationkey"), Profile(code_of(F.col("n_nationkey")), "telecom"))
    return fixed.select("c_custkey", "wallet_currency")


def arrived(spark, sf_dir):
    """Orders with values that arrive as text, some of them broken."""
    slot = F.col("o_orderkey") % 7
    whole = F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice",
        F.when(slot == 0, F.concat(F.lit("-"), whole, F.lit(".75"))).when(slot == 1, "oops").when(slot == 2, None).otherwise(F.concat(F.lit(" "), whole)).alias("qty"),
        F.when(slot == 3, "x1").when(slot == 4, "").otherwise(F.concat(whole, F.lit(".5"))).alias("price"),
        F.when(slot == 0, "Yes").when(slot == 1, "0").when(slot == 2, "perhaps").when(slot == 3, None).otherwise("TRUE").alias("flag"),
        F.when(slot == 5, "not a time").when(slot == 6, None).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("placed"),
        F.when(slot == 5, "31/12").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"))


TYPED = Spec((ColumnSpec("qty", "int"), ColumnSpec("price", "float"), ColumnSpec("flag", "boolean"), ColumnSpec("placed", "datetime"), ColumnSpec("day", "date")))


def coerced(spark, sf_dir, *columns):
    return Q.coerce_types(arrived(spark, sf_dir), TYPED, PORTABLE).select("o_orderkey", *columns)


QTY = "CASE o_orderkey % 7 WHEN 0 THEN -o_custkey WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE o_custkey END"
PRICE = "CASE WHEN o_orderkey % 7 IN (3, 4) THEN 0.0::DOUBLE ELSE o_custkey + 0.5::DOUBLE END"


@query("coerce_numbers", f"SELECT o_orderkey, {QTY} AS qty, {PRICE} AS price FROM orders")
def coerce_numbers(spark, sf_dir):
    return coerced(spark, sf_dir, "qty", "price")


@query("coerce_booleans", "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN NULL ELSE true END AS flag FROM orders")
def coerce_booleans(spark, sf_dir):
    return coerced(spark, sf_dir, "flag")


@query("coerce_times", f"""
    SELECT o_orderkey, CASE o_orderkey % 7 WHEN 5 THEN {S.AS_OF} WHEN 6 THEN NULL ELSE date_trunc('second', o_orderdate) END AS placed,
           CASE o_orderkey % 7 WHEN 5 THEN CAST({S.AS_OF} AS DATE) ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def coerce_times(spark, sf_dir):
    return coerced(spark, sf_dir, "placed", "day")


# Issues per order: qty, price, flag, placed, day.
TYPE_ISSUES = """list_filter([
    CASE o_orderkey % 7 WHEN 2 THEN '' WHEN 1 THEN 'qty: not of its type' ELSE 'qty: read as int' END,
    CASE WHEN o_orderkey % 7 IN (3, 4) THEN 'price: not of its type' ELSE 'price: read as float' END,
    CASE o_orderkey % 7 WHEN 3 THEN '' WHEN 2 THEN 'flag: not of its type' ELSE 'flag: read as boolean' END,
    CASE WHEN o_orderkey % 7 = 5 THEN 'placed: no datetime' ELSE '' END,
    CASE WHEN o_orderkey % 7 = 5 THEN 'day: no date' ELSE '' END], lambda x: x <> '')"""


@query("type_defaults", f"SELECT o_orderkey, array_to_string(list_sort({TYPE_ISSUES}), '; ') AS issues FROM orders")
def type_defaults(spark, sf_dir):
    return coerced(spark, sf_dir, F.concat_ws("; ", F.sort_array("issues")).alias("issues"))


CHOICES = Spec((ColumnSpec("o_orderpriority", "categorical", "weighted_choice", {"choices": ["3 Medium", "1-urgent", "5_LOW"]}),))


@query("repair_choices", f"""
    SELECT o_orderkey, CASE WHEN {S.canonical('o_orderpriority')} IN ('3_medium', '1_urgent', '5_low') THEN o_orderpriority ELSE '3 Medium' END AS o_orderpriority FROM orders""")
def repair_choices(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return Q.repair_choices(orders, CHOICES).drop("issues")


RANGES = Spec((ColumnSpec("c_acctbal", "float", "uniform", {"min": 0, "max": 5000.5}), ColumnSpec("c_nationkey", "int", "int_range", {"lo": 3, "max": 20})))


@query("clamp_ranges", """
    SELECT c_custkey, least(greatest(c_acctbal, 0), 5000.5) AS c_acctbal, least(c_nationkey, 20) AS c_nationkey,
           array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'c_acctbal: below its minimum' ELSE '' END, CASE WHEN c_acctbal > 5000.5 THEN 'c_acctbal: above its maximum' ELSE '' END,
                        CASE WHEN c_nationkey > 20 THEN 'c_nationkey: above its maximum' ELSE '' END], lambda x: x <> ''), '; ') AS issues
    FROM customer""")
def clamp_ranges(spark, sf_dir):
    fixed = Q.clamp_ranges(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), RANGES)
    return fixed.withColumn("issues", F.concat_ws("; ", "issues"))


@query("clamp_percentages", """
    SELECT l_orderkey, l_linenumber, least(100, greatest(0, l_quantity * 3 - 20)) AS discount_pct, l_quantity * 10 AS threshold_percent FROM lineitem""")
def clamp_percentages(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 3 - 20).alias("discount_pct"), (F.col("l_quantity") * 10).alias("threshold_percent"))
    spec = Spec((ColumnSpec("discount_pct", "float"), ColumnSpec("threshold_percent", "float", "uniform", {"max": 1000})))
    return Q.clamp_percentages(lines, spec).drop("issues")


NET = "l_extendedprice * (1.0::DOUBLE - l_discount)"
STORED = f"CASE l_orderkey % 4 WHEN 0 THEN {NET} + 0.005::DOUBLE WHEN 1 THEN {NET} + 5.0::DOUBLE WHEN 2 THEN NULL ELSE {NET} END"


@query("repair_formulas", f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 OR l_orderkey % 4 IN (0, 3) THEN stored ELSE net END AS net,
           CASE WHEN tax IS NULL THEN 'net: formula lacks tax' WHEN l_orderkey % 4 IN (1, 2) THEN 'net: differs from its formula' ELSE '' END AS issue
    FROM (SELECT *, {NET} + l_tax * 0.0::DOUBLE AS net, {STORED} AS stored, CASE WHEN l_tax > 0 THEN l_tax END AS tax FROM lineitem)""")
def repair_formulas(spark, sf_dir):
    lines, slot = table(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 4
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    stored = F.when(slot == 0, net + 0.005).when(slot == 1, net + 5).when(slot == 2, None).otherwise(net)
    base = lines.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"), stored.alias("net"))
    spec = Spec((ColumnSpec("net", "float", "formula", formula="l_extendedprice * (1 - l_discount) + tax * 0"),))
    return Q.repair_formulas(base, spec).select("l_orderkey", "l_linenumber", "net", F.concat_ws("; ", "issues").alias("issue"))


@query("ordered_timestamps", """
    SELECT o_orderkey, l_linenumber, l_suppkey, event_timestamp, d AS notification_dispatch_ts, CASE WHEN r < d THEN d ELSE r END AS customer_response_ts
    FROM (SELECT *, CASE WHEN dispatch < event_timestamp THEN event_timestamp ELSE dispatch END AS d FROM (
        SELECT o_orderkey, l_linenumber, l_suppkey, o_orderdate AS event_timestamp, CASE WHEN l_linenumber <> 4 THEN l_shipdate END AS dispatch, l_shipdate - to_days(CAST(l_quantity AS INTEGER)) AS r
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey))""")
def ordered_timestamps(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("event_timestamp"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_suppkey", F.when(F.col("l_linenumber") != 4, F.col("l_shipdate")).alias("notification_dispatch_ts"),
        F.timestamp_add("DAY", -F.col("l_quantity").cast("int"), F.col("l_shipdate")).alias("customer_response_ts"))
    chain = ["event_timestamp", "notification_dispatch_ts", "customer_response_ts"]
    return Q.ordered_timestamps(orders.join(lines, "o_orderkey"), chain).drop("issues")


PREFIX = {"US": "'+1'", "IN": "'+91'", "GB": "'+44'", "AE": "'+971'", "ZZ": "'+1'"}
PHONE_FIX = {
    "US": "'+1' || lpad(ten, 10, '0')", "ZZ": "'+1' || lpad(ten, 10, '0')",
    "IN": "CASE WHEN length(digits) < 10 OR substr(ten, 1, 1) IN ('6', '7', '8', '9') THEN '+91' || ten ELSE '+919' || right(ten, 9) END",
    "GB": "CASE WHEN length(digits) < 10 OR ten LIKE '7%' THEN '+44' || ten ELSE '+447' || right(ten, 9) END",
    "AE": "'+97150' || right(digits, 7)"}
PHONE = "CASE c_custkey % 4 WHEN 0 THEN '+91 ' || CAST(6000000000 + c_custkey * 1234567 AS VARCHAR) WHEN 1 THEN '(0)' || CAST(c_custkey * 97 AS VARCHAR) WHEN 2 THEN '+44-' || CAST(5123456789 + c_custkey * 3210 AS VARCHAR) END"


@query("repair_phones", f"""
    SELECT c_custkey, CASE WHEN phone <> '' AND NOT starts_with(phone, {code_sql('c_nationkey', PREFIX)}) THEN {code_sql('c_nationkey', PHONE_FIX)} ELSE phone END AS phone
    FROM (SELECT *, right(digits, 10) AS ten FROM (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS digits FROM (SELECT c_custkey, c_nationkey, {PHONE} AS phone FROM customer)))""")
def repair_phones(spark, sf_dir):
    key = F.col("c_custkey")
    text = (F.when(key % 4 == 0, F.concat(F.lit("+91 "), (key * 1234567 + 6000000000).cast("string")))
            .when(key % 4 == 1, F.concat(F.lit("(0)"), (key * 97).cast("string"))).when(key % 4 == 2, F.concat(F.lit("+44-"), (key * 3210 + 5123456789).cast("string"))))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", text.alias("phone"))
    return Q.repair_phones(customers, Profile(code_of(F.col("c_nationkey")), "telecom")).select("c_custkey", "phone")


@query("drop_undeclared_fields", "SELECT o_orderkey, o_orderstatus, o_orderdate AS event_timestamp, 'x' AS event_type FROM orders")
def drop_undeclared_fields(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "event_timestamp").withColumn("event_type", F.lit("x"))
    return Q.drop_undeclared(orders, Spec((ColumnSpec("o_orderkey", "int"), ColumnSpec("o_orderstatus")), events=(EventSpec("x", 1),)))


LABELLED = Spec((ColumnSpec("c_acctbal", "float"), ColumnSpec("c_nationkey", "int")), edge_cases=(EdgeCase("rich", "c_acctbal > 9000"), EdgeCase("low", "c_acctbal < 0 and c_nationkey == 3")))


@query("label_violations", """
    SELECT count(*) FILTER (label AND NOT match) AS labelled_without_match, count(*) FILTER (NOT label AND match) AS matched_without_label
    FROM (SELECT c_custkey % 11 = 0 AS label, c_acctbal > 9000 OR (c_acctbal < 0 AND c_nationkey = 3) AS match FROM customer)""")
def label_violations(spark, sf_dir):
    return Q.label_violations(table(spark, sf_dir, "customer").withColumn("is_edge_case", F.col("c_custkey") % 11 == 0), LABELLED)


# Event histories with faults: users are journeys, arrival is event_id.
DEFINED = (EventSpec("view", 1, ("value",)), EventSpec("click", 2, ("value",)), EventSpec("purchase", 3, ("value", "props")))
BROKEN = """
    SELECT event_id, user_id, value, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '' ELSE 'JRN-' || CAST(user_id AS VARCHAR) END AS journey_id,
           CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'TXN-shared' ELSE 'TXN-' || CAST(event_id // 4 AS VARCHAR) END AS transaction_id,
           CASE WHEN event_id % 13 <> 0 THEN event_type END AS event_type, CAST(CASE WHEN event_id % 4 <> 0 THEN event_id % 4 END AS INTEGER) AS event_sequence,
           CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 11 = 0 THEN ts - to_days(3) ELSE ts END AS event_timestamp,
           CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 8 = 0 THEN 'E-x' ELSE 'E-' || CAST(user_id AS VARCHAR) END AS entity_id
    FROM events"""


def broken(spark, sf_dir, arriving=None):
    i, user = F.col("event_id"), F.col("user_id").cast("string")
    return (table(spark, sf_dir, "events") if arriving is None else arriving).select(
        "event_id", "user_id", "value",
        F.when(i % 5 == 0, None).when(i % 7 == 0, "").otherwise(F.concat(F.lit("JRN-"), user)).alias("journey_id"),
        F.when(i % 6 == 0, None).when(i % 3 == 1, "TXN-shared").otherwise(F.concat(F.lit("TXN-"), F.floor(i / 4).cast("string"))).alias("transaction_id"),
        F.when(i % 13 != 0, F.col("event_type")).alias("event_type"), F.when(i % 4 != 0, i % 4).cast("int").alias("event_sequence"),
        F.when(i % 17 == 0, None).when(i % 11 == 0, F.timestamp_add("DAY", F.lit(-3), F.col("ts"))).otherwise(F.col("ts")).alias("event_timestamp"),
        F.when(i % 9 == 0, None).when(i % 8 == 0, "E-x").otherwise(F.concat(F.lit("E-"), user)).alias("entity_id"))


def new_id(prefix: str, column: str) -> str:
    return f"'{prefix}' || upper({S.hexes('new:' + column, 'event_id')})"


@query("fill_missing_ids", f"""
    SELECT event_id, CASE WHEN coalesce(journey_id, '') = '' THEN {new_id('JRN-', 'journey_id')} ELSE journey_id END AS journey_id,
           CASE WHEN coalesce(transaction_id, '') = '' THEN {new_id('TXN-', 'transaction_id')} ELSE transaction_id END AS transaction_id FROM ({BROKEN})""")
def fill_missing_ids(spark, sf_dir):
    return J.fill_ids(broken(spark, sf_dir), "event_id", PORTABLE).select("event_id", "journey_id", "transaction_id")


@query("renew_repeated_ids", f"""
    SELECT event_id, CASE WHEN transaction_id IS NOT NULL AND row_number() OVER (PARTITION BY transaction_id ORDER BY event_id) > 1
           THEN {new_id('TXN-', 'transaction_id')} ELSE transaction_id END AS transaction_id FROM ({BROKEN})""")
def renew_repeated_ids(spark, sf_dir):
    return J.renew_repeated_ids(broken(spark, sf_dir), "event_id", PORTABLE).select("event_id", "transaction_id")


@query("event_sequences", f"""
    SELECT event_id, coalesce(event_type, 'BUSINESS_EVENT') AS event_type,
           CAST(greatest(1, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE coalesce(event_sequence, 1) END) AS INTEGER) AS event_sequence,
           CASE WHEN event_type IN ('view', 'click', 'purchase') AND coalesce(event_sequence, 1) <> CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END
                THEN 'event_sequence: not the defined one' ELSE '' END AS issue FROM ({BROKEN})""")
def event_sequences(spark, sf_dir):
    return J.set_sequences(broken(spark, sf_dir), DEFINED).select("event_id", "event_type", "event_sequence", F.concat_ws("; ", "issues").alias("issue"))


def by_user(spark, sf_dir):
    rows = broken(spark, sf_dir).withColumn("journey_id", F.concat(F.lit("J"), F.col("user_id").cast("string")))
    return rows.withColumn("event_sequence", F.coalesce("event_sequence", F.lit(1)))


HISTORY = "PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING"


def _ordered(spark, sf_dir, **sizes):
    return J.order_journeys(by_user(spark, sf_dir), "event_id", PORTABLE, "entity_id", **sizes)


ORDER_SQL = f"""
    SELECT event_id, max(coalesce(event_sequence, 1)) OVER ({HISTORY}) AS event_sequence, max(coalesce(event_timestamp, {S.AS_OF})) OVER ({HISTORY}) AS event_timestamp FROM ({BROKEN})"""


@query("journey_order", ORDER_SQL)
def journey_order(spark, sf_dir):
    return _ordered(spark, sf_dir).select("event_id", "event_sequence", "event_timestamp")


@query("journey_order_hot_keys", ORDER_SQL)
def journey_order_hot_keys(spark, sf_dir):
    """The same repair with every user treated as a hot key cut into small chunks."""
    return _ordered(spark, sf_dir, hot_rows=10, chunk_rows=500).select("event_id", "event_sequence", "event_timestamp")


def _spread(rows, by: str):
    """The same arrivals with other distances between them."""
    return rows.withColumn("event_id", F.expr(by))


@query("journey_order_sparse", ORDER_SQL.replace("SELECT event_id,", "SELECT event_id * 1000003 AS event_id,", 1))
def journey_order_sparse(spark, sf_dir):
    """Arrivals a million apart, as a clock in microseconds gives them: chunks still hold a set number of rows."""
    rows = _spread(by_user(spark, sf_dir), "event_id * 1000003")
    return J.order_journeys(rows, "event_id", PORTABLE, "entity_id", hot_rows=10, chunk_rows=50).select("event_id", "event_sequence", "event_timestamp")


@query("journey_order_clustered", ORDER_SQL.replace("SELECT event_id,", "SELECT event_id + event_id // 700 * 1000000000000 AS event_id,", 1))
def journey_order_clustered(spark, sf_dir):
    """Arrivals in dense runs far apart."""
    rows = _spread(by_user(spark, sf_dir), "event_id + event_id div 700 * 1000000000000")
    return J.order_journeys(rows, "event_id", PORTABLE, "entity_id", hot_rows=10, chunk_rows=50).select("event_id", "event_sequence", "event_timestamp")


@query("journey_entity_key", f"SELECT event_id, first_value(entity_id IGNORE NULLS) OVER ({HISTORY}) AS entity_id FROM ({BROKEN})")
def journey_entity_key(spark, sf_dir):
    return _ordered(spark, sf_dir).select("event_id", "entity_id")


# All journey repairs and the row repairs around them, on faulty histories.
FAULTY = f"""SELECT * EXCLUDE (value), CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM ({BROKEN})"""
FAULTY_SPEC = Spec((ColumnSpec("event_id", "int"), ColumnSpec("entity_id", "string", nullable=True), ColumnSpec("value", "float", "uniform", {"min": 5, "max": 60})),
                   events=DEFINED, entity_key="entity_id")
DEFINED_SEQ = "CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END"
FAULTY_FIXED = f"""
    WITH filled AS (
        SELECT event_id, value, coalesce(journey_id, '') = '' AS no_journey, coalesce(transaction_id, '') = '' AS no_txn, transaction_id,
               CASE WHEN coalesce(journey_id, '') = '' THEN {new_id('JRN-', 'journey_id')} ELSE journey_id END AS journey_id,
               coalesce(event_type, 'BUSINESS_EVENT') AS kind, coalesce(event_sequence, 1) AS own, event_timestamp AS ts, entity_id FROM ({FAULTY})),
    marked AS (SELECT *, NOT no_txn AND row_number() OVER (PARTITION BY transaction_id ORDER BY event_id) > 1 AS again,
                      coalesce({DEFINED_SEQ}, own) AS seq, coalesce({DEFINED_SEQ} <> own, false) AS other, coalesce(ts, {S.AS_OF}) AS moment FROM filled),
    scanned AS (SELECT *, max(seq) OVER h AS seq_now, max(moment) OVER h AS ts_now, first_value(entity_id IGNORE NULLS) OVER h AS entity_now
                FROM marked WINDOW h AS (PARTITION BY journey_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, CASE WHEN value IS NULL AND kind IN ('view', 'click', 'purchase') THEN 0.0 WHEN value IS NOT NULL THEN least(60.0, greatest(5.0, value)) END AS value,
           journey_id, CASE WHEN no_txn OR again THEN {new_id('TXN-', 'transaction_id')} ELSE transaction_id END AS transaction_id,
           kind AS event_type, CAST(seq_now AS INTEGER) AS event_sequence, ts_now AS event_timestamp, entity_now AS entity_id,
           array_to_string(list_filter([
               CASE WHEN value < 5 THEN 'value: below its minimum' ELSE '' END, CASE WHEN value > 60 THEN 'value: above its maximum' ELSE '' END,
               CASE WHEN no_journey THEN 'journey_id: missing' ELSE '' END, CASE WHEN no_txn OR again THEN 'transaction_id: missing or repeated' ELSE '' END,
               CASE WHEN other THEN 'event_sequence: not the defined one' ELSE '' END, CASE WHEN ts IS NULL THEN 'event_timestamp: missing' ELSE '' END,
               CASE WHEN seq_now > seq THEN 'event_sequence: below an earlier one of its journey' ELSE '' END,
               CASE WHEN ts_now > moment THEN 'event_timestamp: before an earlier one of its journey' ELSE '' END,
               CASE WHEN entity_now IS DISTINCT FROM entity_id THEN 'entity key: not that of its journey' ELSE '' END,
               CASE WHEN value IS NULL AND kind IN ('view', 'click', 'purchase') THEN '1 missing: defaults taken' ELSE '' END], lambda x: x <> ''), '; ') AS issues
    FROM scanned"""


def faulty_rows(spark, sf_dir, arriving=None):
    rows = broken(spark, sf_dir, arriving)
    return rows.withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value")))


def _validated_faulty(spark, sf_dir, **sizes):
    options = Validation(Profile(None, "telecom"), order="event_id", journeys=True, **sizes)
    fixed = validate(faulty_rows(spark, sf_dir), FAULTY_SPEC, PORTABLE, options)
    return fixed.withColumn("issues", F.concat_ws("; ", "issues"))


@query("validated_journeys_faulty", FAULTY_FIXED)
def validated_journeys_faulty(spark, sf_dir):
    """A whole validation over histories with every kind of fault, with all issues in their order."""
    return _validated_faulty(spark, sf_dir)


@query("validated_journeys_faulty_hot_keys", FAULTY_FIXED)
def validated_journeys_faulty_hot_keys(spark, sf_dir):
    return _validated_faulty(spark, sf_dir, hot_rows=10, chunk_rows=500)


@query("validated_journeys_stream", FAULTY_FIXED)
def validated_journeys_stream(spark, sf_dir):
    """The same validation with the events as a stream: state per journey and transaction id instead of scans."""
    source = table(spark, sf_dir, "events")
    # A pattern, because a stream takes a folder or a pattern, and the table may be a single file.
    arriving = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]")
    path, name = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", f"journeys-{uuid.uuid4().hex}"
    options = Validation(Profile(None, "telecom"), order="event_id", journeys=True)
    stream = repair_stream(faulty_rows(spark, sf_dir, arriving), FAULTY_SPEC, PORTABLE, options)
    write_stream(stream, path, name, continuous=False).awaitTermination()
    fixed = spark.read.schema(stream.schema).parquet(path)
    return fixed.withColumn("issues", F.concat_ws("; ", "issues"))


FILL = Spec((ColumnSpec("o_totalprice", "float"), ColumnSpec("o_orderpriority", "categorical"), ColumnSpec("rush", "boolean"), ColumnSpec("note", "string", nullable=True),
             ColumnSpec("units", "int"), ColumnSpec("doubled", "float", "formula", formula="o_totalprice * 2"), ColumnSpec("per_unit", "float", "formula", formula="o_totalprice / units")))


@query("fill_missing", """
    SELECT o_orderkey, CASE WHEN s = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice, CASE WHEN s = 1 THEN '' ELSE o_orderpriority END AS o_orderpriority,
           coalesce(s = 2, false) AS rush, NULL::VARCHAR AS note, CASE WHEN s IN (0, 3) THEN 0 ELSE s END AS units, CASE WHEN s <> 0 THEN o_totalprice * 2 END AS doubled,
           CASE WHEN s NOT IN (0, 3) THEN o_totalprice / s END AS per_unit FROM (SELECT *, o_orderkey % 5 AS s FROM orders)""")
def fill_missing(spark, sf_dir):
    s, none = F.col("o_orderkey") % 5, F.lit(None)
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(s != 0, F.col("o_totalprice")).alias("o_totalprice"), F.when(s != 1, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(s == 2, True).alias("rush"), none.cast("string").alias("note"), F.when(~s.isin(0, 3), s).alias("units"), none.cast("double").alias("doubled"), none.cast("double").alias("per_unit"))
    return Q.fill_missing(orders, FILL).drop("issues")


@query("fill_missing_by_event", f"""
    SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN coalesce(v, 0.0) ELSE v END AS value, CASE WHEN event_type = 'purchase' THEN coalesce(p, '') ELSE p END AS props
    FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS v, CASE WHEN event_id % 2 <> 0 THEN props END AS p FROM events)""")
def fill_missing_by_event(spark, sf_dir):
    i = F.col("event_id")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(i % 3 != 0, F.col("value")).alias("value"), F.when(i % 2 != 0, F.col("props")).alias("props"))
    spec = Spec((ColumnSpec("value", "float"), ColumnSpec("props", "string")), events=DEFINED)
    return Q.fill_missing(events, spec).select("event_id", "value", "props")


CHECK_LIST = "'" + "; ".join(Q.CHECKS) + "'"


def report_row(checked):
    """The report with its list of checks as text."""
    return Q.validation_report(checked).withColumn("deterministic_checks", F.concat_ws("; ", "deterministic_checks"))


@query("validation_report", f"""
    SELECT count(*) AS total_input, count(*) AS total_valid, 0 AS total_dropped, 0 AS recovered, CAST(sum(len({TYPE_ISSUES})) AS BIGINT) AS algo_fixes, {CHECK_LIST} AS deterministic_checks FROM orders""")
def validation_report(spark, sf_dir):
    return report_row(Q.coerce_types(arrived(spark, sf_dir), TYPED, PORTABLE))


@query("issue_histogram", f"SELECT issue, count(*) AS n FROM (SELECT unnest({TYPE_ISSUES}) AS issue FROM orders) GROUP BY issue")
def issue_histogram(spark, sf_dir):
    return Q.issue_histogram(Q.coerce_types(arrived(spark, sf_dir), TYPED, PORTABLE))
