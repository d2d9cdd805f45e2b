"""Latest-k views, nested documents, table maintenance and naming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import sql as S
from checks.generators import METHODS
from checks.registry import PORTABLE, query, table
from checks.repairs import CODES, code_of, code_sql
from tablesmith.functions.generators import Context, register_generator
from tablesmith.functions.values import first_match
from tablesmith.operators import changes as C
from tablesmith.operators import naming as N
from tablesmith.operators import views as W
from tablesmith.operators.synthesize import synthesize
from tablesmith.session import shared_folder
from tablesmith.sources import batches as B
from tablesmith.spec import ColumnSpec, EventSpec, Spec, resolve_entity_key

# Views over events: users are entities, arrival is event_id.
DEFINED = (EventSpec("view", 1), EventSpec("purchase", 2), EventSpec("click", 3))


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("occurrence_counts", "SELECT user_id, event_type, count(*) AS total_count FROM events GROUP BY user_id, event_type")
def occurrence_counts(spark, sf_dir):
    return W.occurrence_counts(events(spark, sf_dir), "user_id")


@query("latest_records", """
    SELECT event_id, ts, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) <= 10""")
def latest_records(spark, sf_dir):
    return W.latest_k(events(spark, sf_dir), ["user_id", "event_type"], "event_id")


@query("latest_entities", """
    SELECT event_id, ts, user_id, event_type, value FROM events
    WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id ORDER BY min(event_id) DESC LIMIT 10)""")
def latest_entities(spark, sf_dir):
    return W.latest_entities(events(spark, sf_dir), "user_id", "event_id")


NESTED = """
    WITH counted AS (SELECT user_id, event_type, count(*) AS total, min(event_id) AS first FROM events GROUP BY ALL),
    recent AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) <= 10),
    listed AS (SELECT user_id, event_type, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS ids, string_agg(CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR), ' ' ORDER BY event_id) AS amounts FROM recent GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 ELSE 4 END, first) - 1 AS position
               FROM counted JOIN listed USING (user_id, event_type))
    SELECT user_id, position, event_type, total AS total_count, ids, amounts FROM placed"""


def _unfolded(documents):
    flat = documents.select("user_id", F.posexplode("events").alias("position", "e"))
    amounts = F.transform("e.records", lambda r: F.floor(r["value"] * 100).cast("string"))
    return flat.select("user_id", "position", F.col("e.event_type").alias("event_type"), F.col("e.totalCount").alias("total_count"),
                       F.concat_ws(" ", F.col("e.records.event_id").cast("array<string>")).alias("ids"), F.concat_ws(" ", amounts).alias("amounts"))


@query("nested_documents", NESTED)
def nested_documents(spark, sf_dir):
    return _unfolded(W.nest(events(spark, sf_dir), "user_id", DEFINED, "event_id"))


@query("nested_documents_hot_keys", NESTED)
def nested_documents_hot_keys(spark, sf_dir):
    """Users with more than ten events are hot: their records are cut before the shuffle, those of the others after it."""
    return _unfolded(W.nest(events(spark, sf_dir), "user_id", DEFINED, "event_id", hot_rows=10))


@query("identity_attributes", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def identity_attributes(spark, sf_dir):
    return W.identity_attributes(events(spark, sf_dir), "user_id", "event_id", ["event_type", "value"])


@query("keyed_rows", "SELECT event_id, CASE WHEN event_id % 5 > 1 THEN CAST(user_id AS VARCHAR) END AS entity FROM events WHERE event_id % 5 > 1")
def keyed_rows(spark, sf_dir):
    i = F.col("event_id") % 5
    rows = events(spark, sf_dir).select("event_id", F.when(i == 0, None).when(i == 1, "").otherwise(F.col("user_id").cast("string")).alias("entity"))
    return W.keyed_rows(rows, "entity")


@query("renumbered_sequences", "SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS sequence FROM nation")
def renumbered_sequences(spark, sf_dir):
    return W.renumber(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), ["n_regionkey"], "n_nationkey")


@query("unit_totals", "SELECT count(DISTINCT user_id) AS total_count, count(*) AS total_records FROM events")
def unit_totals(spark, sf_dir):
    return W.totals(events(spark, sf_dir), "user_id")


# Keys and references


@query("duplicate_keys", "SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return C.duplicate_keys(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"])


@query("orphan_references", """
    SELECT ref, count(*) AS n FROM (SELECT unnest([o_custkey, o_custkey + CASE WHEN o_orderkey % 40 = 0 THEN 100000 ELSE 0 END]) AS ref FROM orders)
    WHERE ref NOT IN (SELECT c_custkey FROM customer) GROUP BY ref""")
def orphan_references(spark, sf_dir):
    moved = F.col("o_custkey") + F.when(F.col("o_orderkey") % 40 == 0, 100000).otherwise(0)
    orders = table(spark, sf_dir, "orders").select(F.array("o_custkey", moved).alias("ref"))
    return C.orphan_references(orders, "ref", table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


LATE = """
    WITH rows AS (SELECT event_id, event_id % 500 AS name, CASE WHEN event_id % 7 <> 0 THEN (event_id * 7) % 600 END AS needs FROM events),
    first AS (SELECT name, min(event_id) AS defined_at FROM rows GROUP BY name)
    SELECT event_id, needs, defined_at FROM rows LEFT JOIN first ON first.name = needs WHERE needs IS NOT NULL AND coalesce(defined_at >= event_id, true)"""


def _late(spark, sf_dir, hot_rows):
    i = F.col("event_id")
    rows = events(spark, sf_dir).select("event_id", (i % 500).alias("name"), F.when(i % 7 != 0, i * 7 % 600).alias("needs"))
    return C.late_references(rows, "name", "event_id", "needs", hot_rows).select("event_id", "needs", "defined_at")


@query("late_references", LATE)
def late_references(spark, sf_dir):
    return _late(spark, sf_dir, 4_000_000)


@query("late_references_hot_keys", LATE)
def late_references_hot_keys(spark, sf_dir):
    """The same check with most names treated as hot and salted."""
    return _late(spark, sf_dir, 10)


# Change sets


@query("apply_changes", """
    SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'READDED' WHEN c_custkey % 10 = 1 THEN 'EDITED' ELSE c_mktsegment END AS c_mktsegment,
           CASE WHEN c_custkey % 20 = 0 THEN 1.5 WHEN c_custkey % 10 = 2 THEN -7.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 0 OR c_custkey % 20 = 0
    UNION ALL SELECT c_custkey + 1000000, 'READDED', 1.5 FROM customer WHERE c_custkey % 20 = 0""")
def apply_changes(spark, sf_dir):
    base, k = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("c_custkey")
    deletes = base.filter(k % 10 == 0).select("c_custkey")
    edits = base.filter((k % 10).isin(0, 1, 2)).select(
        F.explode(F.array(k, k + 5_000_000)).alias("c_custkey"), F.when(k % 10 == 1, "EDITED").otherwise(" String ").alias("c_mktsegment"), F.when(k % 10 == 2, -7.0).alias("c_acctbal"))
    adds = base.filter(k % 20 == 0).select(F.explode(F.array(k, k + 1_000_000)).alias("c_custkey"), F.lit("READDED").alias("c_mktsegment"), F.lit(1.5).alias("c_acctbal"))
    return C.apply_changes(base, "c_custkey", deletes, edits, adds)


@query("apply_changes_in_order", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def apply_changes_in_order(spark, sf_dir):
    base, k = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("c_custkey")
    one = base.filter(k % 3 == 0).select(k, F.lit("first").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal"), F.lit(1).alias("at"))
    two = base.filter(k % 3 == 0).select(k, F.lit("second").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"), F.lit(2).alias("at"))
    return C.apply_changes(base, "c_custkey", edits=one.unionByName(two), seq="at")


@query("apply_changes_repeated", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'late' WHEN c_custkey % 3 = 1 THEN 'again' ELSE c_mktsegment END AS c_mktsegment,
           CASE WHEN c_custkey % 3 = 0 THEN 1.0 WHEN c_custkey % 3 = 1 THEN 2.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def apply_changes_repeated(spark, sf_dir):
    """Three edits and two adds of one key: the last given value of each field, and the last add, win."""
    base, k = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("c_custkey")
    change = lambda rest, at, segment, balance: base.filter(k % 3 == rest).select(
        k, F.lit(segment).cast("string").alias("c_mktsegment"), F.lit(balance).cast("double").alias("c_acctbal"), F.lit(at).alias("at"))
    edits = change(0, 3, "late", None).unionByName(change(0, 1, "early", 5.0)).unionByName(change(0, 2, "string", 1.0))
    adds = change(1, 2, "again", 2.0).unionByName(change(1, 1, "first", 9.0))
    return C.apply_changes(base, "c_custkey", None, edits, adds, seq="at")


@query("apply_changes_strict", """
    SELECT CASE WHEN n_nationkey % 5 = 2 THEN n_nationkey + 100 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_nationkey % 5 = 1 THEN 'NEW NAME' ELSE n_name END AS n_name
    FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, 'BACK' FROM nation WHERE n_nationkey % 10 = 0""")
def apply_changes_strict(spark, sf_dir):
    base, k = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey")
    edits = base.filter((k % 5).isin(1, 2)).select(k, F.when(k % 5 == 1, "NEW NAME").alias("n_name"), F.when(k % 5 == 2, k + 100).alias("new_key"))
    adds = base.filter(k % 10 == 0).select(k, F.lit("BACK").alias("n_name"))
    return C.apply_changes_strict(base, "n_nationkey", base.filter(k % 5 == 0), edits, adds, renamed="new_key")


@query("change_violations", """
    SELECT n_nationkey + 1000 AS n_nationkey, 'edit of unknown key' AS problem FROM nation UNION ALL SELECT n_nationkey, 'add of existing key' FROM nation WHERE n_nationkey % 4 = 0""")
def change_violations(spark, sf_dir):
    base, k = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey")
    edits = base.select(F.explode(F.array(k, k + F.lit(1000))).alias("n_nationkey"), "n_name")
    return C.change_violations(base, "n_nationkey", edits, base.filter(k % 4 == 0))


GROUPED = """
    WITH kept AS (SELECT l_orderkey, l_suppkey, l_linenumber, CASE WHEN l_suppkey % 10 = 1 THEN 0.5 ELSE l_quantity END AS l_quantity, CASE WHEN l_suppkey % 10 = 2 THEN 'Z' ELSE l_returnflag END AS l_returnflag
                  FROM lineitem WHERE l_suppkey % 10 <> 0),
    added AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber, 9.0 AS l_quantity, 'N' AS l_returnflag FROM lineitem WHERE l_orderkey % 50 = 0 GROUP BY l_orderkey, l_suppkey)
    SELECT * FROM kept WHERE (l_orderkey, l_suppkey) NOT IN (SELECT (l_orderkey, l_suppkey) FROM added) UNION ALL SELECT * FROM added"""


def _grouped(spark, sf_dir, hot_rows):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    names, s = lines.select("l_suppkey").distinct(), F.col("l_suppkey")
    edits = names.filter((s % 10).isin(0, 1, 2)).select(s, F.when(s % 10 == 1, 0.5).alias("l_quantity"), F.when(s % 10 == 2, "Z").otherwise("").alias("l_returnflag"))
    adds = lines.filter(F.col("l_orderkey") % 50 == 0).groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("l_linenumber")).withColumns({"l_quantity": F.lit(9.0), "l_returnflag": F.lit("N")})
    return C.apply_grouped_changes(lines, "l_orderkey", "l_suppkey", "l_orderkey", names.filter(s % 10 == 0), edits, adds, hot_rows)


@query("apply_grouped_changes", GROUPED)
def apply_grouped_changes(spark, sf_dir):
    return _grouped(spark, sf_dir, 4_000_000)


@query("apply_grouped_changes_hot_keys", GROUPED)
def apply_grouped_changes_hot_keys(spark, sf_dir):
    """The same change set with every supplier treated as a hot key."""
    return _grouped(spark, sf_dir, 10)


@query("apply_grouped_changes_repeated", """
    SELECT l_orderkey, l_suppkey, l_linenumber, CASE WHEN l_suppkey % 10 = 1 THEN 4.0 ELSE l_quantity END AS l_quantity, CASE WHEN l_suppkey % 10 = 1 THEN 'B' ELSE l_returnflag END AS l_returnflag
    FROM lineitem WHERE NOT (l_orderkey % 50 = 0)
    UNION ALL SELECT DISTINCT l_orderkey, l_suppkey, CAST(NULL AS INTEGER), 2.0, 'Y' FROM lineitem WHERE l_orderkey % 50 = 0""")
def apply_grouped_changes_repeated(spark, sf_dir):
    """Two edits of one supplier and two adds of one (order, supplier): one row each, with the last values; blank values are not given."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_quantity", "l_returnflag")
    names = lines.select("l_suppkey").distinct().filter(F.col("l_suppkey") % 10 == 1)
    made = lambda rows, at, q, flag: rows.withColumns({"at": F.lit(at), "l_quantity": F.lit(q).cast("double"), "l_returnflag": F.lit(flag)})
    pairs = lines.filter(F.col("l_orderkey") % 50 == 0).select("l_orderkey", "l_suppkey").distinct()
    return C.apply_grouped_changes(lines, "l_orderkey", "l_suppkey", "l_linenumber", None, made(names, 2, 4.0, " string").unionByName(made(names, 1, 3.0, "B")),
                                   made(pairs, 1, 1.0, "X").unionByName(made(pairs, 2, 2.0, "Y")), seq="at")


# Batches of changes that may be applied again


def _twice(apply, spark, path):
    """Apply a batch and apply it again."""
    if not apply() or apply():
        raise ValueError("a batch takes effect once")
    return B.read_table(spark, path)


@query("change_batch_repeated", """
    SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'READDED' WHEN c_custkey % 10 = 1 THEN 'EDITED' ELSE c_mktsegment END AS c_mktsegment,
           CASE WHEN c_custkey % 20 = 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 0 OR c_custkey % 20 = 0
    UNION ALL SELECT c_custkey + 1000000, 'READDED', 1.5 FROM customer WHERE c_custkey % 20 = 0""")
def change_batch_repeated(spark, sf_dir):
    """A change set applied, and applied again: the table of one application."""
    base, k = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("c_custkey")
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    B.create_table(base, path, "c_custkey", buckets=32)
    deletes = base.filter(k % 10 == 0).select("c_custkey")
    edits = base.filter(k % 10 == 1).select("c_custkey", F.lit("EDITED").alias("c_mktsegment"))
    adds = base.filter(k % 20 == 0).select(F.explode(F.array(k, k + 1_000_000)).alias("c_custkey"), F.lit("READDED").alias("c_mktsegment"), F.lit(1.5).alias("c_acctbal"))
    return _twice(lambda: B.apply_change_batch(spark, path, "one", deletes, edits, adds), spark, path)


@query("grouped_change_batch_repeated", """
    SELECT l_orderkey, l_suppkey, l_linenumber, CASE WHEN l_suppkey % 10 = 1 THEN 0.5 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_suppkey % 10 <> 0
    UNION ALL SELECT DISTINCT l_orderkey + 100000000, l_suppkey, 1, 9.0 FROM lineitem WHERE l_suppkey % 10 = 1""")
def grouped_change_batch_repeated(spark, sf_dir):
    """Edits by name would hit the rows the same batch adds if it took effect twice."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_quantity")
    path, names = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", lines.select("l_suppkey").distinct()
    B.create_table(lines, path, "l_suppkey", buckets=32)
    deletes, edited = names.filter("l_suppkey % 10 = 0"), names.filter("l_suppkey % 10 = 1")
    edits = edited.withColumn("l_quantity", F.lit(0.5))
    adds = lines.join(edited, "l_suppkey", "left_semi").select((F.col("l_orderkey") + 100_000_000).alias("l_orderkey"), "l_suppkey").distinct().withColumns(
        {"l_linenumber": F.lit(1), "l_quantity": F.lit(9.0)})
    return _twice(lambda: B.apply_grouped_change_batch(spark, path, "one", "l_orderkey", "l_linenumber", deletes, edits, adds), spark, path)


# Cleaning, names, profiles


@query("clean_placeholders", """
    SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN NULL ELSE lang END AS lang, CASE WHEN lower(trim(source)) IN ('', 'string') THEN NULL ELSE source END AS source,
           CASE WHEN lower(trim(text)) IN ('', 'string') THEN NULL ELSE text END AS text FROM documents""")
def clean_placeholders(spark, sf_dir):
    slot = F.col("doc_id") % 4
    lang = F.when(slot == 0, "  ").when(slot == 1, " String").otherwise(F.col("lang"))
    return C.clean_placeholders(table(spark, sf_dir, "documents").select("doc_id", lang.alias("lang"), "source", "text"))


@query("canonical_columns", "SELECT o_orderkey AS order_id, o_custkey AS subscriber_id, o_totalprice AS recharge_amount, o_orderdate AS event_timestamp, o_orderpriority AS rate_plan_code FROM orders")
def canonical_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("client_id"), F.col("o_orderkey").alias("customer_id"), F.col("o_totalprice").alias("topup_amount"),
        F.col("o_orderdate").alias("event_time"), F.col("o_orderpriority").alias("plan_code"))
    return N.canonical_columns(orders, "Telecom")


@query("normalised_events", """
    SELECT replace(upper(trim(event_type)), ' ', '_') || '_EVENT' AS event_type, position, 'transaction_amount props' AS fields, CAST(greatest(1, low) AS BIGINT) AS min_occurrences,
           CAST(greatest(greatest(1, low), high) AS BIGINT) AS max_occurrences
    FROM (SELECT event_type, min(event_id) AS position, count(*) - 2000 AS low, count(*) AS high FROM events GROUP BY event_type)""")
def normalised_events(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("position"), F.count("*").alias("n"))
    raw = found.select(F.concat(F.lit(" "), "event_type", F.lit(" Event ")).alias("event_type"), "position",
                       F.array(*[F.lit(x) for x in ("payment_amount", " props ", "nowhere", "transaction_amount", "props")]).alias("fields"),
                       (F.col("n") - 2000).alias("min_occurrences"), F.col("n").alias("max_occurrences"))
    return C.normalise_events(raw, ["transaction_amount", "props", "user_id"], N.alias_map("retail")).withColumn("fields", F.concat_ws(" ", "fields"))


INDUSTRY = "CASE n_regionkey WHEN 0 THEN ' Telecom' WHEN 1 THEN 'Retail banking' WHEN 2 THEN 'bank' WHEN 3 THEN 'mining' END"
COUNTRY_SQL = code_sql("n_nationkey", {c: f"'{c}'" for c in CODES})
LISTS = {c: f"'{' '.join(m)}'" for c, m in METHODS.items()}


@query("profile_lookup", f"""
    SELECT n_nationkey, industry_key, {code_sql('n_nationkey', {'US': "'USD'", 'IN': "'INR'", 'GB': "'GBP'", 'AE': "'AED'", 'ZZ': "'USD'"})} AS currency,
           {code_sql('n_nationkey', {'US': "'+1'", 'IN': "'+91'", 'GB': "'+44'", 'AE': "'+971'", 'ZZ': "'+1'"})} AS phone_country_code,
           CASE WHEN noted THEN {code_sql('n_nationkey', LISTS)} ELSE {LISTS['ZZ']} END AS payment_methods,
           CASE industry_key || country WHEN 'telecomUS' THEN '10 25 50 100' WHEN 'telecomIN' THEN '10 19 49 99 199 299 599' WHEN 'telecomGB' THEN '10 15 20 30' WHEN 'telecomAE' THEN '10 25 55 100'
                WHEN 'bankingUS' THEN '20 50 100 500 1000' WHEN 'bankingIN' THEN '100 500 1000 5000' ELSE '10 25 50 100' END AS typical_denominations
    FROM (SELECT *, industry_key || country IN ('telecomUS', 'telecomIN', 'telecomGB', 'telecomAE', 'bankingUS', 'bankingIN') AS noted
          FROM (SELECT n_nationkey, {COUNTRY_SQL} AS country, CASE n_regionkey WHEN 0 THEN 'telecom' WHEN 1 THEN 'banking' WHEN 2 THEN 'banking' ELSE 'generic' END AS industry_key FROM nation))""")
def profile_lookup(spark, sf_dir):
    region = F.col("n_regionkey")
    industry = F.when(region == 0, " Telecom").when(region == 1, "Retail banking").when(region == 2, "bank").when(region == 3, "mining")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", code_of(F.col("n_nationkey")).alias("country"), industry.alias("industry"))
    known = N.with_profile(nations, "country", "industry")
    amounts = F.concat_ws(" ", F.col("typical_denominations").cast("array<bigint>").cast("array<string>"))
    return known.select("n_nationkey", "industry_key", "currency", "phone_country_code", F.concat_ws(" ", "payment_methods").alias("payment_methods"), amounts.alias("typical_denominations"))


# A user's profiles: one industry for each part, at home in one country or anywhere, and generic ones.
PROFILES = """
    SELECT 'GENERIC' AS industry, NULL AS country, -1.0 AS rate UNION ALL SELECT NULL, 'IN', -2.0
    UNION ALL SELECT p_name || ' ' || p_partkey, 'us', p_retailprice FROM part
    UNION ALL SELECT p_name || ' ' || p_partkey, NULL, p_retailprice + 0.5 FROM part WHERE p_size > 15"""
LOOSE = f"""
    SELECT o_orderkey, {code_sql('o_orderkey', {c: f"'{c}'" for c in CODES})} AS country,
           CASE o_orderkey % 6 WHEN 0 THEN ' ' || upper(name) WHEN 1 THEN 'the ' || name || ' trade' WHEN 2 THEN substr(name, 3) WHEN 3 THEN 'mining' WHEN 4 THEN name END AS industry
    FROM (SELECT o_orderkey, p_name || ' ' || p_partkey AS name FROM orders LEFT JOIN part ON p_partkey = o_custkey)"""


@query("profile_table_lookup", f"""
    WITH known AS MATERIALIZED (SELECT coalesce(lower(industry), 'generic') AS industry, coalesce(upper(country), 'GLOBAL') AS country, rate FROM ({PROFILES})),
    names AS MATERIALIZED (SELECT DISTINCT industry AS name FROM known WHERE industry <> 'generic'),
    loose AS MATERIALIZED (SELECT *, coalesce(lower(trim(industry)), 'generic') AS text FROM ({LOOSE})),
    meant AS MATERIALIZED (
        SELECT text, first(name ORDER BY CASE WHEN text = name THEN 0 WHEN contains(text, name) THEN 1 ELSE 2 END, CASE WHEN contains(text, name) THEN -length(name) ELSE length(name) END, name) AS name
        FROM (SELECT DISTINCT text FROM loose WHERE text <> 'generic') JOIN names ON contains(text, name) OR contains(name, text) GROUP BY text),
    keyed AS (SELECT o_orderkey, country, coalesce(name, 'generic') AS industry_key FROM loose LEFT JOIN meant USING (text))
    SELECT o_orderkey, industry_key, coalesce(a.rate, b.rate, c.rate, d.rate) AS rate FROM keyed
    LEFT JOIN known a ON a.industry = industry_key AND a.country = keyed.country LEFT JOIN known b ON b.industry = industry_key AND b.country = 'GLOBAL'
    LEFT JOIN known c ON c.industry = 'generic' AND c.country = keyed.country LEFT JOIN known d ON d.industry = 'generic' AND d.country = 'GLOBAL'""")
def profile_table_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.concat_ws(" ", "p_name", "p_partkey").alias("industry"))
    fixed = spark.createDataFrame([("GENERIC", None, -1.0), (None, "IN", -2.0)], "industry string, country string, rate double")
    home = part.select("industry", F.lit("us").alias("country"), F.col("p_retailprice").alias("rate"))
    anywhere = part.filter("p_size > 15").select("industry", F.lit(None).cast("string").alias("country"), (F.col("p_retailprice") + 0.5).alias("rate"))
    key, name = F.col("o_orderkey"), F.col("industry")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("p_partkey")).join(part, "p_partkey", "left")
    words = [F.concat(F.lit(" "), F.upper(name)), F.concat(F.lit("the "), name, F.lit(" trade")), F.substring(name, F.lit(3), F.length(name)), F.lit("mining"), name]
    loose = orders.select(key, code_of(key).alias("country"), first_match([(key % 6 == i, w) for i, w in enumerate(words)], F.lit(None).cast("string")).alias("industry"))
    known = N.with_profile_table(loose, fixed.unionByName(home).unionByName(anywhere), "country", "industry", "o_orderkey")
    return known.select("o_orderkey", "industry_key", "rate")


@query("entity_key_resolution", "SELECT c_custkey AS entity_key, count(*) AS n FROM customer GROUP BY c_custkey")
def entity_key_resolution(spark, sf_dir):
    """An unknown key falls back to the canonical identifier, here the renamed customer key."""
    customers = N.canonical_columns(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "client_id"), "retail")
    key = resolve_entity_key("nowhere", customers.columns, N.canonical_name("identifier", "retail"))
    return customers.groupBy(F.col(key).alias("entity_key")).agg(F.count("*").alias("n"))


def even_number(ctx: Context):
    return ctx.draws.below(int(ctx.params["half"])) * 2


@query("registered_generator", f"SELECT c_custkey, {S.below(50, 'lucky', 'c_custkey')} * 2 AS lucky FROM customer")
def registered_generator(spark, sf_dir):
    register_generator("even_number", even_number)
    spec = Spec((ColumnSpec("lucky", "int", "even_number", {"half": 50}),))
    return synthesize(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", spec, PORTABLE)
