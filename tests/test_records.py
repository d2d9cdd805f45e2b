"""Journeys, repairs, views, change sets, definition files and streams."""

import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks.jobs import definition_text
from tablesmith.functions.profiles import Profile, match_industry
from tablesmith.operators import changes as C
from tablesmith.operators import edgecases as E
from tablesmith.operators import journeys as J
from tablesmith.operators import naming as N
from tablesmith.operators import quality as Q
from tablesmith.operators import views as W
from tablesmith.operators.synthesize import Settings
from tablesmith.plans.presets import account_sample, low_balance_catalog, recharge_sample
from tablesmith.plans.scenario import (Validation, generate_journeys, generate_records, kept_records, set_aside_records,
                                       validate, validate_to)
from tablesmith.sources.definitions import load_columns, load_spec
from tablesmith.sources.sink import public_names, write_records
from tablesmith.spec import ColumnSpec, EdgeCase, EventSpec, Spec
from tablesmith.streaming.records import repair_stream, write_stream

SET = Settings(seed=2, as_of=datetime(2024, 6, 1))
ORDER = Validation(Profile(None, "telecom"), order="row_id", journeys=True)


# Journeys


def test_clock_in_the_row_equals_clock_by_window(spark, monkeypatch):
    events = (EventSpec("B", 2, (), 1, 5), EventSpec("A", 1, (), 2, 3), EventSpec("C", 2, (), 1, 1))
    entities = spark.range(60)
    inside = sorted(map(str, J.fan_out(entities, "id", events, SET).collect()))
    monkeypatch.setattr(J, "CLOCK_IN_ROW", 0)
    assert sorted(map(str, J.fan_out(entities, "id", events, SET).collect())) == inside


def test_fan_out_respects_bounds_and_order(spark):
    events = (EventSpec("A", 1, (), 2, 4), EventSpec("B", 2, (), 1, 1))
    rows = J.fan_out(spark.range(200), "id", events, SET).orderBy("id", "event_sequence", "event_occurrence").collect()
    per = {}
    for r in rows:
        per.setdefault(r.id, []).append(r)
    assert len(per) == 200
    for rs in per.values():
        a = [r for r in rs if r.event_type == "A"]
        assert 2 <= len(a) <= 4 and len(rs) == len(a) + 1
        gaps = [y.elapsed_seconds - x.elapsed_seconds for x, y in zip(rs, rs[1:])]
        assert all(5 <= g <= 300 for g in [rs[0].elapsed_seconds, *gaps])


def test_repeated_and_missing_ids_become_unique(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "same" if i % 3 else f"t{i}", "" if i % 5 == 0 else f"j{i % 3}") for i in range(60)],
                               "at long, transaction_id string, journey_id string")
    fixed = J.renew_repeated_ids(J.fill_ids(df, "at", SET), "at", SET)
    rows = {r.at: r for r in fixed.collect()}
    assert len({r.transaction_id for r in rows.values()}) == 60 and rows[1].transaction_id == "same"
    assert rows[0].transaction_id.startswith("TXN-") and rows[5].journey_id.startswith("JRN-") and rows[1].issues == []
    assert rows[2].issues == ["transaction_id: missing or repeated"]


def test_validated_journeys_are_stable_and_ordered(spark):
    spec = recharge_sample()
    df = generate_journeys(spark.range(80), "id", spec, SET)
    late = F.when(F.col("row_id") % 5 == 0, F.timestamp_add("DAY", F.lit(-2), F.col("event_timestamp"))).otherwise(F.col("event_timestamp"))
    broken = (df.withColumn("event_timestamp", late).withColumn("event_sequence", F.when(F.col("row_id") % 7 == 0, 9).otherwise(F.col("event_sequence")))
              .withColumn("balance_after", F.when(F.col("row_id") % 3 == 0, -1.0).otherwise(F.col("balance_after"))).drop("payment_method_type"))
    fixed = validate(broken, spec, SET, ORDER).cache()
    E.check_labels(fixed, spec, 1)
    again = validate(fixed.drop("issues"), spec, SET, ORDER)
    # A fully absent optional input is reported each time; nothing else is left to fix.
    assert Q.issue_histogram(again).count() == 0
    order = fixed.select("journey_id", "row_id", "event_sequence", "event_timestamp").orderBy("journey_id", "row_id").collect()
    for a, b in zip(order, order[1:]):
        assert a.journey_id != b.journey_id or (a.event_sequence <= b.event_sequence and a.event_timestamp <= b.event_timestamp)
    assert Q.validation_report(fixed).first().algo_fixes > 0
    fixed.unpersist()


FAULTS = (EventSpec("start", 1), EventSpec("stop", 2))


def faulty_history(spark):
    rows = [(i * 1000, None if i % 9 == 0 else f"j{i % 4}", "same" if i % 3 == 0 else None if i % 5 == 0 else f"t{i}", ("start", "stop", "odd", None)[i % 4 if i % 7 else 3],
             (i * 5) % 6, None if i % 8 == 0 else datetime(2024, 1, 1, i * 7 % 24), None if i % 6 == 0 else f"e{i % 4 if i % 10 else 9}", "wide") for i in range(200)]
    return spark.createDataFrame(rows, "at long, journey_id string, transaction_id string, event_type string, event_sequence int, event_timestamp timestamp_ntz, owner string, wide string")


@pytest.mark.parametrize("sizes", [{}, {"hot_rows": 5, "chunk_rows": 7}])
def test_one_join_repairs_as_the_steps_do(spark, sizes):
    df = faulty_history(spark)
    steps = J.renew_repeated_ids(J.fill_ids(df, "at", SET), "at", SET)
    steps = J.order_journeys(J.set_sequences(steps, FAULTS), "at", SET, "owner", **sizes)
    once = J.repair_journeys(df, "at", FAULTS, SET, "owner", **sizes)
    assert once.schema == steps.schema
    assert [r.asDict() for r in once.orderBy("at").collect()] == [r.asDict() for r in steps.orderBy("at").collect()]
    none = df.filter("at < 0")
    assert J.repair_journeys(none, "at", FAULTS, SET, "owner", **sizes).count() == 0


def test_journey_repairs_move_wide_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = J.repair_journeys(faulty_history(spark), "at", FAULTS, SET, "owner")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = shown.splitlines()
    moved = [lines[i + 1] for i, line in enumerate(lines) if "Exchange" in line]
    assert len([line for line in moved if "wide" in line]) == 1, shown


def test_rows_that_cannot_meet_their_case_are_set_aside(spark, tmp_path):
    spec = Spec((ColumnSpec("id", "int"), ColumnSpec("kind", "categorical", "weighted_choice", {"choices": ["a", "b"]}), ColumnSpec("free", "string", nullable=True)),
                edge_cases=(EdgeCase("is_b", "kind == 'b'"),))
    df = spark.createDataFrame([(1, "a", None, "is_b", True), (2, "b", None, None, True), (3, "a", None, None, True), (4, "a", "x", "gone", True), (5, "a", "y", None, False)],
                               "id int, kind string, free string, edge_case_name string, is_edge_case boolean")
    with pytest.raises(Exception, match="meets no edge case|cannot be satisfied"):
        validate(df, spec, SET, Validation(key="id")).collect()
    path = str(tmp_path / "out")
    report = validate_to(df, spec, SET, path, Validation(key="id")).first()
    assert (report.total_input, report.total_valid, report.total_dropped, report.recovered) == (5, 3, 2, 0)
    assert {r.id: (r.kind, r.is_edge_case) for r in kept_records(spark, path).collect()} == {1: ("b", True), 2: ("b", True), 5: ("a", False)}
    aside = {r.id: (r.kind, r.is_edge_case, r.issues) for r in set_aside_records(spark, path).collect()}
    assert aside == {3: ("a", True, ["label: meets no edge case"]), 4: ("a", True, ["edge case cannot be satisfied: gone"])}
    with pytest.raises(Exception, match="already exists"):
        validate_to(df, spec, SET, path, Validation(key="id"))
    nothing = validate_to(df.limit(0), spec, SET, str(tmp_path / "none"), Validation(key="id")).first()
    assert (nothing.total_input, nothing.total_dropped, nothing.algo_fixes) == (0, 0, 0)


def test_a_scenario_without_events_gets_a_default_one(spark):
    spec = Spec((ColumnSpec("customer_id", "string", "prefixed_int", {"prefix": "C-", "digits": 6}),), entity_key="customer_id")
    df = generate_journeys(spark.range(30), "id", spec, SET)
    assert [r.event_type for r in df.select("event_type").distinct().collect()] == ["BUSINESS_EVENT"]
    assert df.groupBy("customer_id").count().filter("count NOT BETWEEN 1 AND 10").count() == 0


# Repairs


def test_fresh_records_need_no_fix_and_broken_ones_are_repaired_once(spark):
    spec = account_sample()
    df = generate_records(spark.range(400), "id", spec, SET, 400, "id")
    assert Q.validation_report(validate(df, spec, SET)).first().algo_fixes == 0
    broken = df.withColumns({"balance": F.when(F.col("id") % 10 == 0, -5.0).otherwise(F.col("balance")), "plan_type": F.when(F.col("id") % 9 == 0, "PRE PAID").otherwise(F.col("plan_type")),
                             "monthly_spend": F.when(F.col("id") % 8 == 0, "oops").otherwise(F.col("monthly_spend").cast("string"))})
    fixed = validate(broken, spec, SET).cache()
    E.check_labels(fixed, spec, 16)
    assert fixed.schema["monthly_spend"].dataType.simpleString() == "double"
    # A balance raised to 0 would meet an edge case, so normal rows take the nearest value that does not: one below.
    raised = fixed.filter("id % 10 = 0 AND NOT is_edge_case")
    assert raised.filter("balance = -1").count() == raised.filter("array_contains(issues, 'balance: below its minimum')").count() == raised.count() > 0
    assert fixed.filter("id % 10 != 0 AND balance < 0 OR plan_type NOT IN ('prepaid', 'postpaid')").count() == 0
    again = Q.issue_histogram(validate(fixed.drop("issues"), spec, SET)).collect()
    assert [r.issue for r in again] == ["balance: below its minimum"]
    assert Q.label_violations(fixed, spec).first().asDict() == {"labelled_without_match": 0, "matched_without_label": 0}
    fixed.unpersist()


def test_declared_percentage_bounds_win(spark):
    df = spark.createDataFrame([(1, 250.0, 120.0, -3)], "id long, dynamic_lb_threshold_pct double, share_pct double, growth_percent int")
    spec = Spec((low_balance_catalog().column("dynamic_lb_threshold_pct"), ColumnSpec("share_pct", "float"), ColumnSpec("growth_percent", "int")))
    row = Q.clamp_percentages(df, spec).first()
    assert (row.dynamic_lb_threshold_pct, row.share_pct, row.growth_percent) == (250.0, 100.0, 0)


@pytest.mark.parametrize("country, given, wanted", [
    ("IN", "+1 (987) 654-3210", "+919876543210"), ("IN", "+11234567890", "+919234567890"), ("GB", "7123456789", "+447123456789"), ("GB", "0044 20 7946 0958", "+447079460958"),
    ("AE", "1234567", "+971501234567"), ("US", "+4412", "+10000004412"), ("US", "+15551234567", "+15551234567"), ("US", None, None), ("US", "", ""), ("IN", "123", "+91123")])
def test_phone_conventions(spark, country, given, wanted):
    df = spark.createDataFrame([(1, given)], "id long, contact_phone string")
    assert Q.repair_phones(df, Profile(country)).first().contact_phone == wanted


def test_coercions_follow_the_word_lists(spark):
    texts = [" 7.9 ", "-7.9", "x", "", None, "1e3", "nan", "inf"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, n string")
    rows = [r.n for r in Q.coerce_types(df, Spec((ColumnSpec("n", "int"),)), SET).orderBy("id").collect()]
    assert rows == [7, -7, 0, 0, None, 1000, 0, 0]
    flags = spark.createDataFrame([(0, 1), (1, 0), (2, 5), (3, None)], "id long, f int")
    assert [r.f for r in Q.coerce_types(flags, Spec((ColumnSpec("f", "boolean"),)), SET).orderBy("id").collect()] == [True, False, False, None]
    times = spark.createDataFrame([(0, "2024-02-03T04:05:06Z"), (1, "2024-02-03T04:05:06+02:00"), (2, "2024-02-30"), (3, None)], "id long, t string")
    got = [r.t for r in Q.coerce_types(times, Spec((ColumnSpec("t", "datetime"),)), SET).orderBy("id").collect()]
    assert got == [datetime(2024, 2, 3, 4, 5, 6), datetime(2024, 2, 3, 2, 5, 6), datetime(2024, 6, 1), None]


# Views


def test_documents_keep_definition_order_and_the_newest_records(spark):
    rows = [(i, "a" if i % 3 else "b", ["Z", "CLICK", "VIEW"][i % 3], f"+1{i}") for i in range(90)]
    rows += [(900, None, "VIEW", ""), (901, "", "VIEW", ""), (-2, "b", None, ""), (-1, "b", "", "")]
    df = spark.createDataFrame(rows, "at long, subscriber_id string, event_type string, phone_number string")
    docs = {d.subscriber_id: d for d in W.nest(df, "subscriber_id", (EventSpec("VIEW", 1), EventSpec("CLICK", 2)), "at", k=4).collect()}
    assert set(docs) == {"a", "b"} and docs["a"].phone_number == "+189"
    assert [(e.event_type, e.totalCount) for e in docs["a"].events] == [("VIEW", 30), ("CLICK", 30)]
    assert [r["at"] for r in docs["a"].events[0].records] == [80, 83, 86, 89]
    assert [(e.event_type, e.totalCount) for e in docs["b"].events] == [("BUSINESS_EVENT", 2), ("Z", 30)]


def test_latest_k_is_cut_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id AS at", "id % 3 AS k")
    plan = W.latest_k(df, ["k"], "at", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_projection_and_public_names(spark):
    spec = account_sample()
    df = generate_records(spark.range(10), "id", spec, SET, 10, "id")
    assert W.ordered_projection(df, spec).columns == [*spec.names, "is_edge_case"]
    assert public_names(df, spec).columns[-1] == "isEdgeCaseData"


# Change sets


def test_strict_changes_reject_bad_sets(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    make = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    for bad in (dict(edits=make((3, "x"))), dict(adds=make((1, "x"))), dict(adds=make((5, "x"), (5, "y"))), dict(deletes=make((1, "")), edits=make((1, "x")))):
        with pytest.raises(ValueError, match="strict"):
            C.apply_changes_strict(base, "k", **bad)
    renames = spark.createDataFrame([(1, None, 2)], "k int, v string, to int")
    with pytest.raises(ValueError, match="strict"):
        C.apply_changes_strict(base, "k", edits=renames, renamed="to")
    done = C.apply_changes_strict(base, "k", deletes=make((2, "")), edits=renames, adds=make((1, "new")), renamed="to")
    assert sorted(map(tuple, done.collect())) == [(1, "new"), (2, "a")]


def test_edits_apply_in_order_and_blanks_do_not(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, v string, w double")
    edits = spark.createDataFrame([(1, "x", None, 1), (1, "", 5.0, 2), (1, "string", None, 3), (9, "q", 1.0, 1)], "k int, v string, w double, seq int")
    assert sorted(map(tuple, C.apply_changes(base, "k", edits=edits, seq="seq").collect())) == [(1, "x", 5.0), (2, "b", 2.0)]


def test_repeated_changes_need_a_sequence(spark):
    base = spark.createDataFrame([(1, "g", "a"), (2, "g", "b")], "k int, g string, v string")
    twice = spark.createDataFrame([(1, "g", "x"), (1, "g", "y")], "k int, g string, v string")
    for changes in (dict(edits=twice), dict(adds=twice)):
        with pytest.raises(Exception, match="without a sequence"):
            C.apply_changes(base, "k", **changes).collect()
        with pytest.raises(Exception, match="without a sequence"):
            C.apply_grouped_changes(base, "g", "k", "v", **changes).collect()


def test_small_change_sets_leave_the_base_in_place(spark):
    base = spark.range(1000).withColumn("v", F.lit("a"))
    done = C.apply_changes(base, "id", edits=spark.range(5).withColumn("v", F.lit("b")))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and "FullOuter" not in plan and done.filter("v = 'b'").count() == 5


def test_ids_of_one_day_do_not_collide(spark):
    rows = spark.range(3_000_000).selectExpr("id", "'E' AS event_type", "1 AS event_occurrence", "0L AS elapsed_seconds")
    made = J.with_metadata(rows, "id", SET)
    assert made.select(F.count_distinct("transaction_id")).first()[0] == 3_000_000


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tablesmith.session import shared_folder

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="share"):
        shared_folder(cluster)


def test_placeholder_keys_and_values_count_as_not_given(spark):
    base = spark.createDataFrame([("a", "x"), ("string", "y")], "k string, v string")
    make = lambda *rows: spark.createDataFrame(rows, "k string, v string")
    done = C.apply_changes(base, "k", deletes=make((" String ", None)), edits=make(("", "z")), adds=make(("b", "string"), (None, "q")))
    assert sorted(map(str, done.collect())) == sorted(map(str, make(("a", "x"), ("string", "y"), ("b", None)).collect()))


def test_placeholders_are_cleaned_inside_structs(spark):
    df = spark.sql("SELECT struct('String' AS a, struct('x' AS c, '' AS d) AS b) AS s, named_struct('a', ' ') AS t, 5 AS n, 'ok' AS o")
    row = C.clean_placeholders(df).first()
    assert (row.s.a, row.s.b.c, row.s.b.d, row.t, row.n, row.o) == (None, "x", None, None, 5, "ok")


def test_names_and_industries():
    assert N.canonical_name("identifier", "Telecom services") == "subscriber_id" and N.canonical_name("identifier") == "customer_id"
    assert N.alias_map("retail")["msisdn"] == "phone_number" and "customer_id" not in N.alias_map("retail")
    assert [match_industry(x) for x in ("Retail", "retail banking", "tele", "mining", None)] == ["retail", "banking", "telecom", "generic", "generic"]


# Definition files


def written(tmp_path, text, bom=True):
    path = tmp_path / "definition.csv"
    path.write_text(text, encoding="utf-8-sig" if bom else "utf-8")
    return str(path)


@pytest.mark.parametrize("make, key", [(account_sample, None), (recharge_sample, "subscriber_id")])
def test_both_sample_layouts_round_trip(spark, tmp_path, make, key):
    spec = load_spec(spark, written(tmp_path, definition_text(make())), key)
    want = make()
    assert spec.names == want.names and spec.events == want.events and spec.edge_fraction == want.edge_fraction
    assert [(c.name, c.condition, c.event_type, [o.name for o in c.overrides]) for c in spec.edge_cases] == [
        (c.name, c.condition, c.event_type, [o.name for o in c.overrides]) for c in want.edge_cases]
    assert [(c.dtype, c.gen, c.params, c.formula, c.nullable) for c in spec.columns] == [(c.dtype, c.gen, c.params, c.formula, c.nullable) for c in want.columns]


HEAD = "record_type,name,dtype,gen,params,depends_on,formula,event_type,sequence,fields,edge_case_name,condition,value\n"


@pytest.mark.parametrize("body, message", [
    ("variable,a,nope,uniform,,,,,,,,,", "dtype"), ("variable,a,float,nope,,,,,,,,,", "generator"), ("variable,a,float,uniform,,b,,,,,,,", "earlier row"),
    ("variable,a,float,uniform,{bad,,,,,,,,", "valid JSON"), ("variable,a,float,uniform,[1],,,,,,,,", "JSON object"), ("variable,a,float,formula,,,,,,,,,", "needs a formula"),
    ("variable,a,float,uniform,,,,,,,,,\nvariable,a,float,uniform,,,,,,,,,", "duplicate"), ("other,a,float,uniform,,,,,,,,,", "record_type"), ("event,,,,,,,E,1,,,,", "no variable"),
    ("variable,a,float,uniform,,,,,,,,,\nevent,,,,,,,E,1,zz,,,", "undeclared"), ("variable,a,float,uniform,,,,,,,,,\nevent,,,,,,,E,0,a,,,", "at least 1"),
    ("variable,a,float,uniform,,,,,,,,,\nevent,,,,,,,E,1,a,,,\nevent,,,,,,,e,2,a,,,", "duplicate event"),
    ("variable,a,float,uniform,,,,,,,,,\nedge_case_variable,a,,,,,,,,,X,zz > 1,", "undeclared"), ("variable,a,float,uniform,,,,,,,,,\nedge_case_variable,a,,,,,,,,,X,a +,", "not supported"),
    ("variable,a,float,uniform,,,,,,,,,\nmetadata,edgeCasePercentage,,,,,,,,,,,1.5", "between 0 and 1")])
def test_bad_definitions_are_rejected(spark, tmp_path, body, message):
    with pytest.raises(ValueError, match=message):
        load_spec(spark, written(tmp_path, HEAD + body + "\n"), "a" if "event" in body else None)


def test_columns_only_layout_and_edge_only_columns(spark, tmp_path):
    spec = load_columns(spark, written(tmp_path, "name,dtype,gen,params\nflag,bool,constant,\"{\"\"value\"\": true}\"\nn,int,int_range,\n", bom=False))
    assert spec.column("flag").dtype == "boolean" and spec.column("flag").params == {"value": True}
    extra = load_spec(spark, written(tmp_path, HEAD + "variable,a,float,uniform,,,,,,,,,\nedge_case_variable,b,int,constant,\"{\"\"value\"\": 3}\",,,,,,X,b == 3,\nmetadata,edgeCasePercentage,,,,,,,,,,,0.5\n"))
    assert extra.names == ["a", "b"] and extra.edge_cases[0].name == "X" and extra.edge_fraction == 0.5


def test_records_are_written_by_event_and_read_back(spark, tmp_path):
    df = generate_journeys(spark.range(20), "id", recharge_sample(), SET)
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        write_records(df, path, fmt)
        back = spark.read.schema(df.schema).format(fmt).load(path)
        assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert {p.name for p in (tmp_path / "json").iterdir() if p.is_dir()} == {"event_type=BALANCE_LOW", "event_type=RECHARGE_COMPLETED"}
    with pytest.raises(ValueError, match="format"):
        write_records(df, str(tmp_path / "x"), "xml")


def test_stream_gives_the_same_rows_as_the_batch(spark, tmp_path):
    spec = Spec((ColumnSpec("n", "int", "int_range", {"min": 0, "max": 50}), ColumnSpec("w", "categorical", "weighted_choice", {"choices": ["x", "y"]})))
    source = str(tmp_path / "in")
    spark.range(200).selectExpr("id", "cast(id AS string) AS n", "if(id % 3 = 0, 'zz', 'Y') AS w").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("id long, n string, w string").parquet(source)
    name = f"records-{uuid.uuid4().hex}"
    write_stream(repair_stream(stream, spec, SET), str(tmp_path / "out"), name, continuous=False).awaitTermination(120)
    want = validate(spark.read.parquet(source), spec, SET)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_few_partitions_of_keys_are_dealt_over_tasks(spark, monkeypatch):
    from tablesmith.plans import scenario as P

    keys, spec = spark.range(0, 100, 1, 1).withColumnRenamed("id", "k"), recharge_sample()
    want = sorted(map(repr, P.generate_journeys(keys, "k", spec, Settings(seed=1, as_of=datetime(2024, 6, 1))).collect()))
    monkeypatch.setattr(P, "KEYS_PER_TASK", 10)
    made = P.generate_journeys(keys, "k", spec, Settings(seed=1, as_of=datetime(2024, 6, 1)))
    assert made.rdd.getNumPartitions() == 10
    assert sorted(map(repr, made.collect())) == want


def test_journey_repairs_make_their_rows_twice(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(i):
        made.add(1)
        return f"T{i}"

    rows = spark.range(200).select(F.col("id").alias("row"), F.concat(F.lit("J"), F.col("id") % 9).alias("journey_id"),
                                   F.udf(counted)("id").alias("transaction_id"), F.lit("VIEW").alias("event_type"), F.lit(1).alias("event_sequence"),
                                   F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("event_timestamp"))
    fixed = J.repair_journeys(rows, "row", (EventSpec("VIEW", 1),), Settings(seed=1, as_of=datetime(2024, 6, 1)))
    assert fixed.filter(F.size("issues") > 0).select("transaction_id").count() == 0
    assert 200 <= made.value <= 400
