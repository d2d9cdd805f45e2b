from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.functions.draws import Draws, permutation
from tablesmith.functions.profiles import Profile
from tablesmith.operators.synthesize import Settings, synthesize, synthesize_range
from tablesmith.plans.presets import low_balance_catalog, suppression_catalog
from tablesmith.spec import ColumnSpec, Spec

AS_OF = datetime(2024, 6, 1)


def settings(mode="fast", **more):
    return Settings(seed=3, as_of=AS_OF, mode=mode, **more)


@pytest.mark.parametrize("mode", ["fast", "portable"])
def test_same_rows_for_any_partitioning(spark, mode):
    spec = low_balance_catalog()
    results = []
    for parts in (1, 4, 16):
        df = spark.range(0, 500, 1, parts).withColumnRenamed("id", "unit")
        results.append(sorted(map(str, synthesize(df, "unit", spec, settings(mode)).collect())))
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("modulus", [9, 90, 9_000_000, 9 * 10**11])
def test_permutation_is_a_bijection(modulus):
    a, b = permutation(1, "f", modulus)
    sample = range(min(modulus, 5000))
    assert len({(x * a + b) % modulus for x in sample}) == len(sample)
    assert (modulus - 1) * a + b < 1 << 63


@pytest.mark.parametrize("mode", ["fast", "portable"])
def test_draws_are_uniform_and_independent_of_slot(spark, mode):
    d = Draws(1, "f", F.col("id"), 0, mode)
    row = spark.range(20000).select(*[d.unit(s).alias(f"u{s}") for s in range(6)]).agg(
        *[F.avg(f"u{s}").alias(f"m{s}") for s in range(6)], F.corr("u0", "u1").alias("c01"), F.corr("u0", "u4").alias("c04")).first()
    assert all(abs(row[f"m{s}"] - 0.5) < 0.02 for s in range(6))
    assert abs(row.c01) < 0.04 and abs(row.c04) < 0.04


def test_full_catalog_respects_its_own_rules(spark):
    df = synthesize_range(spark, 4000, low_balance_catalog(), settings())
    assert len(df.columns) == 36
    broken = df.filter(
        ~F.col("customer_lifetime_value").between(25, 2500) | ~F.col("response_time_seconds").between(10, 86400)
        | ~F.col("churn_propensity_score").between(0, 1) | (F.col("balance_before") > F.col("low_balance_threshold_amt"))
        | (F.abs(F.col("balance_after") - F.col("balance_before") - F.col("recharge_amount")) > 0.006)
        | (F.col("notification_dispatch_ts") <= F.col("event_timestamp")) | (F.col("customer_response_ts") <= F.col("notification_dispatch_ts"))
        | (F.replace("account_id", F.lit("ACC-PRE-"), F.lit("SUB-")) != F.col("subscriber_id"))
        | (F.col("balance_expiry_date_new") != F.date_add(F.col("event_timestamp").cast("date"), 30))
        | ~F.col("subscriber_msisdn").rlike(r"^\+1[2-9]\d{2}[2-9]\d{2}[1-9]\d{3}$") | ~F.col("trigger_event_id").rlike("^trig-[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
        | (F.col("event_timestamp") > F.lit(AS_OF)))
    assert broken.count() == 0
    row = df.agg(F.countDistinct("subscriber_id").alias("ids"), F.avg((F.col("loyalty_tier_customer") == "Bronze").cast("int")).alias("bronze"),
                 F.avg("churn_propensity_score").alias("churn")).first()
    assert row.ids == 4000 and abs(row.bronze - 0.4) < 0.04 and abs(row.churn - 2 / 7) < 0.02


def test_suppression_catalog_is_consistent(spark):
    df = synthesize_range(spark, 4000, suppression_catalog(), settings())
    quiet = F.col("local_hour").isin(21, 22, 23, 0, 1, 2, 3, 4, 5, 6)
    reason = F.col("suppression_reason_code")
    broken = df.filter(
        (quiet != (reason == "QUIET_HOURS_RESTRICTION")) | ((F.col("pending_txn_id").isNotNull()) != (reason == "PENDING_IN_FLIGHT_TXN"))
        | ((F.col("alerts_sent_last_24h") > 0) != (reason == "FREQUENCY_CAP_EXCEEDED"))
        | (F.col("last_outbound_timestamp").isNull() != (F.col("alerts_sent_last_24h") == 0))
        | (F.col("subsequent_topup_timestamp").isNull() != (F.col("campaign_attribution_nature") == "UNCONVERTED"))
        | (F.col("balance_after").isNull() != F.col("subsequent_recharge_amount").isNull()))
    assert broken.count() == 0


def test_fractional_beta_uses_arrow_and_keeps_its_mean(spark):
    spec = Spec((ColumnSpec("b", "float", "beta", {"alpha": 2.5, "beta": 4.5}),))
    df = synthesize(spark.range(4000), "id", spec, settings())
    assert abs(df.agg(F.avg("b")).first()[0] - 2.5 / 7) < 0.02
    assert df.orderBy("id").collect() == synthesize(spark.range(0, 4000, 1, 7), "id", spec, settings()).orderBy("id").collect()


def test_fractional_beta_follows_its_distribution(spark):
    """Quantiles against numpy's own draws and the known mean and variance; no Python in the plan."""
    shapes = {"even": (0.5, 0.5), "skewed": (2.5, 1.3), "rare": (0.1, 5), "large": (40.5, 30.25), "tiny": (0.02, 0.03)}
    spec = Spec(tuple(ColumnSpec(n, "float", "beta", {"alpha": a, "beta": b}) for n, (a, b) in shapes.items()))
    df = synthesize(spark.range(60_000), "id", spec, settings())
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    rows, rng = df.toPandas(), np.random.default_rng(4)
    for n, (a, b) in shapes.items():
        want, mean, spread = np.floor(rng.beta(a, b, 400_000) * 1e4 + 0.5) / 1e4, a / (a + b), (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        assert rows[n].between(0, 1).all() and abs(rows[n].mean() - mean) < 0.02 * spread + 2e-4 and abs(rows[n].std() - spread) < 0.02 * spread + 2e-4
        for at in np.quantile(want, [0.05, 0.25, 0.5, 0.75, 0.95]):
            assert abs((rows[n] <= at).mean() - (want <= at).mean()) < 0.01, (n, at)


def test_ids_past_the_digit_space_get_longer(spark):
    spec = Spec((ColumnSpec("s", "string", "prefixed_int", {"prefix": "S-", "digits": 2}),))
    assert synthesize(spark.range(90), "id", spec, settings()).select("s").distinct().count() == 90
    more = synthesize(spark.range(12_000_000 - 5000, 12_000_000).union(spark.range(5000)), "id", spec, settings())
    assert more.select("s").distinct().count() == 10_000 and more.filter("id < 90 AND length(s) = 4").count() == 90
    with pytest.raises(Exception, match="negative key"):
        synthesize(spark.range(-1, 0), "id", spec, settings()).collect()


def test_text_keys_work(spark):
    df = spark.createDataFrame([("x",), ("y",)], "k string")
    spec = Spec((ColumnSpec("s", "string", "prefixed_int", {"prefix": "S-", "digits": 8}), ColumnSpec("u", "float", "uniform", {"min": 1, "max": 2})))
    rows = synthesize(df, "k", spec, settings()).collect()
    assert all(len(r.s) == 10 and 1 <= r.u <= 2 for r in rows) and rows[0].s != rows[1].s


def test_unknown_generator_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown generator"):
        synthesize(spark.range(1), "id", Spec((ColumnSpec("a", "string", "nope"),)), settings())


def test_payment_choices_depend_on_country_and_industry(spark):
    column = ColumnSpec("payment_method", "categorical", "weighted_choice", {"choices": ["UPI", "PAYPAL"], "weights": [1, 1]})

    def values(country, industry):
        made = synthesize(spark.range(200), "id", Spec((column,)), settings(profile=Profile(country, industry)))
        return {r.payment_method for r in made.collect()}

    assert values("IN", "telecom") == {"UPI"}
    assert values("US", "telecom") == {"PAYPAL"}
    # Without notes for the country the generic methods apply, and none of the choices is among them.
    assert values("IN", None) == {"credit_card", "debit_card", "bank_transfer", "digital_wallet", "cash"}


def test_columns_already_present_are_kept(spark):
    df = spark.range(5).withColumn("u", F.lit(7.0))
    spec = Spec((ColumnSpec("u", "float", "uniform", {"min": 0, "max": 1}), ColumnSpec("v", "float", "formula", formula="u * 2")))
    assert {r.v for r in synthesize(df, "id", spec, settings()).collect()} == {14.0}
