"""Value generators on customer keys and event times."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import PORTABLE, SEED, query, table
from tablesmith.functions.draws import permutation
from tablesmith.functions.profiles import Profile
from tablesmith.functions.values import first_match
from tablesmith.operators.synthesize import Settings, synthesize
from tablesmith.spec import ColumnSpec, Spec

KEY = "c_custkey"


def on_customer(name: str, columns: list[ColumnSpec], sql_columns: dict[str, str], *, extra: tuple[str, ...] = (),
                settings=lambda: PORTABLE):
    """Register a generator query: spec columns over customer against SQL expressions over customer."""
    spec = Spec(tuple(columns))
    select = ", ".join([KEY, *extra, *[f"{e} AS {n}" for n, e in sql_columns.items()]])

    def run(spark, sf_dir):
        base = table(spark, sf_dir, "customer").select(KEY, *extra)
        return synthesize(base, KEY, spec, settings()).select(KEY, *extra, *sql_columns)

    query(name, f"SELECT {select} FROM customer")(run)


def prefixed(prefix: str, digits: int, field: str, key: str = KEY) -> str:
    low, size = 10 ** (digits - 1), 9 * 10 ** (digits - 1)
    a, b = permutation(SEED, field, size)
    return f"'{prefix}' || CAST({low} + ({key} * {a} + {b}) % {size} AS VARCHAR)"


SUBSCRIBER = ColumnSpec("subscriber_id", "string", "prefixed_int", {"prefix": "SUB-", "digits": 8})
BALANCE = ColumnSpec("balance", "float", "uniform", {"min": 0, "max": 500})
EVENT_TIME = ColumnSpec("event_timestamp", "datetime", "recent_datetime", {"days_back": 30})
SUBSCRIBER_SQL = prefixed("SUB-", 8, "subscriber_id")
BALANCE_SQL = S.cents(0, 500, "balance", KEY)


def event_time_sql(days: int = 30, field: str = "event_timestamp", key: str = KEY) -> str:
    parts = [f"{S.below(n, field, key, slot)} * {unit}" for slot, (n, unit) in
             enumerate([(days + 1, 86400), (24, 3600), (60, 60), (60, 1)])]
    return f"({S.AS_OF} - to_seconds({' + '.join(parts)}))"


on_customer("gen_prefixed_int", [SUBSCRIBER], {"subscriber_id": SUBSCRIBER_SQL})
on_customer(
    "gen_id_mirror",
    [SUBSCRIBER, ColumnSpec("account_id", "string", "id_mirror",
                            {"prefix": "ACC-PRE-", "source_field": "subscriber_id", "source_prefix": "SUB-"})],
    {"account_id": prefixed("ACC-PRE-", 8, "subscriber_id")},
)


def phone_sql(field: str, code: str) -> str:
    pad = lambda n, slot: f"lpad(CAST({S.below(10**n, field, KEY, slot)} AS VARCHAR), {n}, '0')"
    if code == "+91":
        return f"'+91' || CAST({S.between(6, 9, field, KEY, 1)} AS VARCHAR) || {pad(9, 2)}"
    if code == "+44":
        return f"'+447' || {pad(9, 1)}"
    if code == "+971":
        return f"'+971' || ['50','52','54','55','56','58'][CAST({S.below(6, field, KEY, 1)} AS INTEGER) + 1] || {pad(7, 2)}"
    area, exchange, line = (S.between(lo, hi, field, KEY, s) for s, lo, hi in ((1, 200, 999), (2, 200, 999), (3, 1000, 9999)))
    return f"'{code}' || CAST({area} AS VARCHAR) || CAST({exchange} AS VARCHAR) || CAST({line} AS VARCHAR)"


CODES = ["+1", "+91", "+44", "+971"]
on_customer(
    "gen_e164_phone",
    [ColumnSpec("phone", "string", "e164_phone", {"country_codes": CODES})],
    {"phone": S.choice([phone_sql("phone", c) for c in CODES], [1.0] * 4, "phone", KEY)},
)

# Customers stand in for four countries by nation key, so country rules vary by row.
COUNTRY_SQL = "CASE c_nationkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'IN' WHEN 2 THEN 'GB' WHEN 3 THEN 'AE' ELSE 'ZZ' END"
COUNTRY_OF = {0: "US", 1: "IN", 2: "GB", 3: "AE"}


def country_column():
    slot = F.col("c_nationkey") % 5
    return first_match([(slot == value, F.lit(code)) for value, code in COUNTRY_OF.items()], F.lit("ZZ"))


def by_country() -> Settings:
    return Settings(seed=SEED, as_of=PORTABLE.as_of, mode="portable", profile=Profile(country_column(), "telecom"))


on_customer(
    "gen_constant",
    [ColumnSpec("status", "string", "constant", {"value": "ACTIVE"}),
     ColumnSpec("wallet_currency", "string", "constant", {"value": "EUR"})],
    {"status": "'ACTIVE'",
     "wallet_currency": "CASE c_nationkey % 5 WHEN 1 THEN 'INR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'AED' ELSE 'USD' END"},
    extra=("c_nationkey",), settings=by_country,
)
PLAN = ColumnSpec("plan_type", "categorical", "weighted_choice", {"choices": ["prepaid", "postpaid"], "weights": [0.7, 0.3]})
PLAN_SQL = S.choice(["'prepaid'", "'postpaid'"], [0.7, 0.3], "plan_type", KEY)
on_customer(
    "gen_weighted_choice",
    [PLAN,
     ColumnSpec("days", "int", "weighted_choice", {"choices": [7, 28, 84], "weights": [0.2, 0.5, 0.3]}),
     ColumnSpec("level", "categorical", "weighted_choice", {"choices": ["a", "b", "c"], "weights": [0, 0]}),
     ColumnSpec("nothing", "categorical", "weighted_choice", {"choices": []})],
    {"plan_type": PLAN_SQL, "days": S.choice(["7", "28", "84"], [0.2, 0.5, 0.3], "days", KEY),
     "level": S.choice(["'a'", "'b'", "'c'"], [1.0] * 3, "level", KEY), "nothing": "CAST(NULL AS VARCHAR)"},
)
# What stays allowed of UPI / Credit Card / PayPal in telecom: IN keeps the first two, US and GB the last two.
PAYMENT = ColumnSpec("payment_method", "categorical", "weighted_choice",
                     {"choices": ["UPI", "Credit Card", "PayPal"], "weights": [0.5, 0.3, 0.2]})
CASH_ONLY = ColumnSpec("second_payment", "categorical", "weighted_choice", {"choices": ["Barter", "Cheque"], "weights": [1, 1]})
METHODS = {
    "US": ["credit_card", "debit_card", "bank_account", "bank_transfer", "ach", "digital_wallet", "paypal", "cash"],
    "IN": ["upi", "credit_card", "debit_card", "net_banking", "bank_transfer", "digital_wallet", "cash", "cod"],
    "GB": ["credit_card", "debit_card", "bank_transfer", "direct_debit", "digital_wallet", "paypal", "cash"],
    "AE": ["credit_card", "debit_card", "bank_transfer", "digital_wallet", "cash"],
    "ZZ": ["credit_card", "debit_card", "bank_transfer", "digital_wallet", "cash"],
}


def per_country_sql(arms: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {slot} THEN {arms[code]}" for slot, code in COUNTRY_OF.items())
    return f"(CASE c_nationkey % 5 {whens} ELSE {arms['ZZ']} END)"


CARD_OR_PAYPAL = S.choice(["'Credit Card'", "'PayPal'"], [0.3, 0.2], "payment_method", KEY)
on_customer(
    "gen_country_aware_choice",
    [PAYMENT, CASH_ONLY],
    {"payment_method": per_country_sql({
        "US": CARD_OR_PAYPAL, "GB": CARD_OR_PAYPAL, "AE": "'Credit Card'", "ZZ": "'Credit Card'",
        "IN": S.choice(["'UPI'", "'Credit Card'"], [0.5, 0.3], "payment_method", KEY)}),
     "second_payment": per_country_sql({
         c: S.choice(S.texts(m), [1.0] * len(m), "second_payment", KEY) for c, m in METHODS.items()})},
    extra=("c_nationkey",), settings=by_country,
)
on_customer(
    "gen_uniform",
    [BALANCE, ColumnSpec("lohi", "float", "uniform", {"lo": "1.5", "hi": 9}), ColumnSpec("swapped", "float", "uniform", {"min": 5, "max": 2})],
    {"balance": BALANCE_SQL, "lohi": S.cents(1.5, 9, "lohi", KEY), "swapped": "5.0::DOUBLE"},
)
on_customer(
    "gen_uniform_wide",
    [ColumnSpec("amount", "float", "uniform", {"min": 0, "max": 1_000_000_000})],
    {"amount": f"(CAST(((CAST({S.u32('amount', KEY, 0)} AS HUGEINT) * 4294967296 + {S.u32('amount', KEY, 1)}) * 100000000001) // 18446744073709551616 AS DOUBLE) / 100.0::DOUBLE)"},
)
on_customer(
    "gen_lognormal",
    [ColumnSpec("clv", "float", "lognormal", {"mu": 5.5, "sigma": 0.8, "min": 25.0, "max": 2500.0})],
    {"clv": S.rounded(f"greatest(25.0::DOUBLE, least(2500.0::DOUBLE, exp(5.5::DOUBLE + 0.8::DOUBLE * {S.standard_normal('clv', KEY)})))")},
)
on_customer(
    "gen_lognormal_int",
    [ColumnSpec("wait", "int", "lognormal_int", {"mu": 5.5, "sigma": 1.2, "min": 10, "max": 86400})],
    {"wait": f"CAST(greatest(10.0::DOUBLE, least(86400.0::DOUBLE, floor(exp(5.5::DOUBLE + 1.2::DOUBLE * {S.standard_normal('wait', KEY)})))) AS BIGINT)"},
)
on_customer(
    "gen_beta",
    [ColumnSpec("churn", "float", "beta", {"alpha": 2, "beta": 5})],
    {"churn": S.rounded(f"list_sort([{', '.join(S.u32('churn', KEY, i) for i in range(6))}])[2] / 4294967296.0::DOUBLE", 4)},
)
SHAPES = {"even": (0.5, 0.5), "skewed": (2.5, 1.3), "rare": (0.1, 5)}


def log_gamma_sql(field: str, shape: float, which: int, trials: int = 12) -> str:
    d = (shape if shape >= 1 else shape + 1) - 1 / 3
    c = 1 / math.sqrt(9 * d)
    inner = lambda slot: f"(({S.u32(field, KEY, slot)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    rows = ", ".join(f"{{'x': sqrt(-2.0::DOUBLE * ln({inner(k)})) * cos({2 * math.pi!r}::DOUBLE * {inner(k + 1)}), 'u': {inner(k + 2)}}}"
                     for k in range(3 * trials * which, 3 * trials * (which + 1), 3))
    t = f"(1 + {c!r}::DOUBLE * r.x)"
    fits = f"ln(r.u) < 0.5::DOUBLE * r.x * r.x + {d!r}::DOUBLE - {d!r}::DOUBLE * ({t} * {t} * {t}) + {3 * d!r}::DOUBLE * ln({t})"
    taken = f"list_transform([{rows}], lambda r: CASE WHEN {t} <= 0 THEN NULL WHEN {fits} THEN 3 * ln({t}) END)"
    value = f"{math.log(d)!r}::DOUBLE + coalesce(list_filter({taken}, lambda v: v IS NOT NULL)[1], 0.0::DOUBLE)"
    return f"({value})" if shape >= 1 else f"({value} + ln({inner(6 * trials + which)}) / {shape!r}::DOUBLE)"


on_customer(
    "gen_beta_fractional",
    [ColumnSpec(n, "float", "beta", {"alpha": a, "beta": b}) for n, (a, b) in SHAPES.items()],
    {n: S.rounded(f"1 / (1 + exp({log_gamma_sql(n, b, 1)} - {log_gamma_sql(n, a, 0)}))", 4) for n, (a, b) in SHAPES.items()},
)
SEGMENTS = {"BUILDING": (100.0, 150.0), "MACHINERY": (150.0, 200.0), "HOUSEHOLD": (200.0, 300.0)}


def ranges_sql(field: str) -> str:
    draw = {k: f"(CAST({round(lo * 10000)} + {S.below(round((hi - lo) * 10000) + 1, field, KEY)} AS DOUBLE) / 10000.0::DOUBLE)"
            for k, (lo, hi) in SEGMENTS.items()}
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in draw.items())
    return f"(CASE c_mktsegment {whens} ELSE {draw['BUILDING']} END)"


on_customer(
    "gen_segment_range",
    [ColumnSpec("threshold", "float", "segment_range",
                {"segment_field": "c_mktsegment", **{k: {"min": lo, "max": hi} for k, (lo, hi) in SEGMENTS.items()}})],
    {"threshold": ranges_sql("threshold")}, extra=("c_mktsegment",),
)
on_customer(
    "gen_uniform_bounded",
    [ColumnSpec("spend", "float", "uniform_bounded", {"lo": 0.5, "hi_field": "c_acctbal"})],
    {"spend": "CAST(50 + (" + S.u32("spend", KEY) + " * (CAST(floor(greatest(0.5::DOUBLE, c_acctbal) * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) - 50 + 1)) // 4294967296 AS DOUBLE) / 100.0::DOUBLE"},
    extra=("c_acctbal",),
)
on_customer("gen_recent_datetime", [EVENT_TIME], {"event_timestamp": event_time_sql()})
on_customer(
    "gen_prefixed_uuid",
    [ColumnSpec("trigger_id", "string", "prefixed_uuid", {"prefix": "trig-"})],
    {"trigger_id": "'trig-' || substr(concat_ws('-', " + ", ".join(
        f"substr({S.hexes('trigger_id', KEY)}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + "), 6, 36)"},
)
on_customer(
    "gen_formula",
    [BALANCE, ColumnSpec("fee", "float", "formula", formula="round(min(15.0, max(0.5, balance * (c_acctbal / 100))), 2) - -c_nationkey % 7")],
    {"fee": S.rounded(f"least(15.0::DOUBLE, greatest(0.5::DOUBLE, {BALANCE_SQL} * (c_acctbal / 100.0::DOUBLE)))")
     + " - (-(c_nationkey::DOUBLE) - floor(-(c_nationkey::DOUBLE) / 7.0::DOUBLE) * 7.0::DOUBLE)"},
    extra=("c_nationkey", "c_acctbal"),
)


def on_events(name: str, column: ColumnSpec, expression: str):
    """Register a time generator on event times."""

    def run(spark, sf_dir):
        base = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
        return synthesize(base, "event_id", Spec((column,)), PORTABLE).select("event_id", column.name)

    query(name, f"SELECT event_id, {expression} AS {column.name} FROM events")(run)


on_events("gen_ts_offset", ColumnSpec("sent_at", "datetime", "ts_offset", {"base_field": "ts", "min_sec": 1, "max_sec": 10}),
          S.seconds_later("ts", S.between(1, 10, "sent_at", "event_id")))
on_events("gen_ts_add_field", ColumnSpec("done_at", "datetime", "ts_add_field", {"base_field": "ts", "add_seconds_field": "user_id"}),
          S.seconds_later("ts", "user_id"))
on_events("gen_date_offset", ColumnSpec("expires", "date", "date_offset", {"base_field": "ts", "days": 30}),
          "CAST(CAST(ts AS DATE) + 30 AS DATE)")


@query("gen_tx_id", f"SELECT event_id, 'PG-TXN-' || strftime(ts, '%Y%m%d') || '-' || CAST({S.between(1000000, 9999999, 'transaction_id', 'event_id')} AS VARCHAR) AS transaction_id FROM events")
def gen_tx_id(spark, sf_dir):
    base = table(spark, sf_dir, "events").selectExpr("event_id", "ts AS event_timestamp")
    spec = Spec((ColumnSpec("transaction_id", "string", "tx_id", {"prefix": "PG-TXN-"}),))
    return synthesize(base, "event_id", spec, PORTABLE).select("event_id", "transaction_id")


def column_sql(c: ColumnSpec, key: str = KEY) -> str:
    """SQL for a catalog column over the columns before it."""
    p, n = c.params, c.name
    if c.gen == "prefixed_int":
        return prefixed(p["prefix"], p["digits"], n, key)
    if c.gen == "id_mirror":
        return f"'{p['prefix']}' || replace({p['source_field']}, '{p['source_prefix']}', '')"
    if c.gen == "e164_phone":
        return phone_sql(n, p["country_codes"][0])
    if c.gen == "weighted_choice":
        cast = {"int": "BIGINT", "float": "DOUBLE"}.get(c.dtype, "VARCHAR")
        return S.choice([f"CAST('{v}' AS {cast})" for v in p["choices"]], p["weights"], n, key)
    if c.gen == "constant":
        return f"'{p['value']}'"
    if c.gen == "uniform":
        return S.cents(p["min"], p["max"], n, key)
    if c.gen in ("lognormal", "lognormal_int"):
        raw = f"exp({p['mu']}::DOUBLE + {p['sigma']}::DOUBLE * {S.standard_normal(n, key)})"
        clipped = "greatest({0}::DOUBLE, least({1}::DOUBLE, {2}))".format(float(p["min"]), float(p["max"]), raw if c.gen == "lognormal" else f"floor({raw})")
        return S.rounded(clipped) if c.gen == "lognormal" else f"CAST({clipped} AS BIGINT)"
    if c.gen == "beta":
        draws = ", ".join(S.u32(n, key, i) for i in range(p["alpha"] + p["beta"] - 1))
        return S.rounded(f"list_sort([{draws}])[{p['alpha']}] / 4294967296.0::DOUBLE", 4)
    if c.gen == "segment_range":
        arms = {k: f"(CAST({round(v['min'] * 10000)} + {S.below(round((v['max'] - v['min']) * 10000) + 1, n, key)} AS DOUBLE) / 10000.0::DOUBLE)" for k, v in p.items()}
        return "CASE subscriber_segment " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in arms.items()) + " END"
    if c.gen == "uniform_bounded":
        cents = f"CAST(floor(greatest({p['lo']}::DOUBLE, {p['hi_field']}) * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
        return f"(CAST(({S.u32(n, key)} * ({cents} + 1)) // 4294967296 AS DOUBLE) / 100.0::DOUBLE)"
    if c.gen == "prefixed_uuid":
        parts = ", ".join(f"substr({S.hexes(n, key)}, {at}, {size})" for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"'{p['prefix']}' || substr(concat_ws('-', {parts}), {len(p['prefix']) + 1}, 36)"
    if c.gen == "tx_id":
        return f"'{p['prefix']}' || strftime(event_timestamp, '%Y%m%d') || '-' || CAST({S.between(1000000, 9999999, n, key)} AS VARCHAR)"
    if c.gen == "recent_datetime":
        return event_time_sql(p["days_back"], n, key)
    if c.gen == "ts_offset":
        return S.seconds_later(p["base_field"], S.between(p["min_sec"], p["max_sec"], n, key))
    if c.gen == "ts_add_field":
        return S.seconds_later(p["base_field"], p["add_seconds_field"])
    if c.gen == "date_offset":
        return f"CAST({p['base_field']} AS DATE) + {p['days']}"
    raise ValueError(f"no SQL for {c.gen}")
