"""The suppression generators, each on customer keys through the columns it depends on."""

from __future__ import annotations

from checks import sql as S
from checks.generators import KEY, event_time_sql
from checks.registry import PORTABLE, query, table
from tablesmith.operators.synthesize import synthesize
from tablesmith.plans.presets import suppression_catalog


def tag(column: str, gen: str, *path: str) -> str:
    """Draw field of a nested generator."""
    return "/".join([column, gen, *path])


def pick(column: str, gen: str, path: tuple[str, ...], options: dict[str, float]) -> str:
    return S.choice(list(options), list(options.values()), tag(column, gen, *path), KEY)


def hours(column: str, gen: str, path: tuple[str, ...], low: float, high: float) -> str:
    return S.between(round(low * 100), round(high * 100), tag(column, gen, *path), KEY)


def cents(column: str, gen: str, path: tuple[str, ...], low: float, high: float) -> str:
    return S.cents(low, high, tag(column, gen, *path), KEY)


ELSE = ("otherwise",)
EVEN = dict.fromkeys
LAST_OUT = hours("last_outbound_timestamp", "lb02_last_outbound_ts", ELSE, 0.5, 23.5)
LATER = hours("subsequent_topup_timestamp", "lb02_subsequent_ts", ELSE, 0.5, 48)
WAKING = S.between(7, 20, tag("local_hour", "lb02_local_hour", "otherwise"), KEY)
TWICE = ("otherwise", "otherwise")

# Column -> SQL over the columns before it.
STEPS = [
    ("telecom_circle_code", S.choice(S.texts(["US_EAST_NY", "US_WEST_CA", "US_CENTRAL_TX", "US_SOUTH_FL", "US_OTHER"]), [1.0] * 5, "telecom_circle_code", KEY)),
    ("auto_recharge_mandate_status", S.choice(S.texts(["PROCESSING_IN_FLIGHT", "ACTIVE_IDLE", "NONE"]), [0.1, 0.2, 0.7], "auto_recharge_mandate_status", KEY)),
    ("campaign_attribution_nature", S.choice(S.texts(["UNCONVERTED", "AUTO_RECURRING", "ORGANIC"]), [0.4, 0.2, 0.4], "campaign_attribution_nature", KEY)),
    ("event_timestamp", event_time_sql()),
    ("balance_before", S.cents(0, 15, "balance_before", KEY)),
    ("subscriber_local_tz", "CASE telecom_circle_code WHEN 'US_WEST_CA' THEN 'America/Los_Angeles' WHEN 'US_CENTRAL_TX' THEN 'America/Chicago' ELSE 'America/New_York' END"),
    ("is_auto_recharge_enabled", "auto_recharge_mandate_status IN ('PROCESSING_IN_FLIGHT', 'ACTIVE_IDLE') OR " + pick("is_auto_recharge_enabled", "lb02_auto_recharge_enabled", ELSE, {"false": 0.85, "true": 0.15})),
    ("suppression_reason_code", "CASE WHEN auto_recharge_mandate_status = 'PROCESSING_IN_FLIGHT' THEN 'AUTO_RECHARGE_ACTIVE' ELSE " + pick("suppression_reason_code", "lb02_suppression_reason", ELSE, {
        "'RECENT_RECHARGE_COOLDOWN'": 0.40, "'PENDING_IN_FLIGHT_TXN'": 0.20, "'FREQUENCY_CAP_EXCEEDED'": 0.20, "'AUTO_RECHARGE_ACTIVE'": 0.10, "'QUIET_HOURS_RESTRICTION'": 0.10}) + " END"),
    ("zone_hour_", "(hour(event_timestamp) + CASE subscriber_local_tz WHEN 'America/Los_Angeles' THEN -7 WHEN 'America/Chicago' THEN -5 ELSE -4 END + 24) % 24"),
    ("local_hour", "CASE WHEN suppression_reason_code = 'QUIET_HOURS_RESTRICTION' THEN " + pick("local_hour", "lb02_local_hour", ("then",), EVEN("21 22 23 0 1 2 3 4 5 6".split(), 1.0)) + f" WHEN zone_hour_ >= 21 OR zone_hour_ <= 6 THEN {WAKING} ELSE zone_hour_ END"),
    ("hours_since_last_recharge", "CASE WHEN suppression_reason_code = 'RECENT_RECHARGE_COOLDOWN' THEN " + cents("hours_since_last_recharge", "lb02_hours_since_recharge", ("then",), 0.25, 23.99) + " ELSE " + cents("hours_since_last_recharge", "lb02_hours_since_recharge", ELSE, 24.01, 720) + " END"),
    ("last_recharge_timestamp", "event_timestamp - to_seconds(CAST(round(hours_since_last_recharge * 100) AS BIGINT) * 36)"),
    ("pending_txn_id", "CASE WHEN suppression_reason_code = 'PENDING_IN_FLIGHT_TXN' THEN 'TXN-PG-' || CAST(" + S.between(100000000, 999999999, tag("pending_txn_id", "lb02_pending_txn_id", "then"), KEY) + " AS VARCHAR) END"),
    ("alerts_sent_last_24h", "CASE WHEN suppression_reason_code = 'FREQUENCY_CAP_EXCEEDED' THEN " + S.between(1, 3, tag("alerts_sent_last_24h", "lb02_alerts_sent", "then"), KEY) + " ELSE 0 END"),
    ("last_outbound_timestamp", f"CASE WHEN alerts_sent_last_24h <> 0 THEN event_timestamp - to_seconds({LAST_OUT} * 36) END"),
    ("decision_engine_action", "CASE suppression_reason_code WHEN 'QUIET_HOURS_RESTRICTION' THEN 'QUEUED_FOR_MORNING' WHEN 'RECENT_RECHARGE_COOLDOWN' THEN 'SUPPRESSED_SILENT' WHEN 'AUTO_RECHARGE_ACTIVE' THEN 'SUPPRESSED_SILENT' ELSE 'DROPPED' END"),
    ("journey_state", "CASE WHEN decision_engine_action = 'QUEUED_FOR_MORNING' THEN 'DEFERRED_PENDING' ELSE 'CLOSED_SUPPRESSED' END"),
    ("subsequent_topup_timestamp", f"CASE WHEN campaign_attribution_nature <> 'UNCONVERTED' THEN event_timestamp + to_seconds({LATER} * 36) END"),
    ("subsequent_channel", "CASE WHEN subsequent_topup_timestamp IS NULL THEN NULL WHEN campaign_attribution_nature = 'AUTO_RECURRING' THEN 'AUTO_DEBIT_ACH' ELSE " + pick("subsequent_channel", "lb02_subsequent_channel", TWICE, {"'MY_ACCOUNT_APP'": 0.60, "'RETAILER_POS'": 0.25, "'WEB_PORTAL'": 0.15}) + " END"),
    ("subsequent_payment", "CASE WHEN subsequent_topup_timestamp IS NULL THEN NULL WHEN campaign_attribution_nature = 'AUTO_RECURRING' THEN 'DIRECT_DEBIT' ELSE " + pick("subsequent_payment", "lb02_subsequent_payment", TWICE, {"'CREDIT_CARD'": 0.40, "'DEBIT_CARD'": 0.35, "'DIGITAL_WALLET'": 0.25}) + " END"),
    ("subsequent_recharge_amount", "CASE WHEN subsequent_topup_timestamp IS NULL THEN NULL ELSE " + pick("subsequent_recharge_amount", "lb02_subsequent_amount", ELSE, {"10.0::DOUBLE": 0.30, "20.0::DOUBLE": 0.50, "50.0::DOUBLE": 0.20}) + " END"),
    ("balance_after", S.rounded("balance_before + subsequent_recharge_amount")),
]

# Query name -> column it checks.
CHECKED = {
    "gen_circle_tz_lookup": "subscriber_local_tz", "gen_lb02_auto_recharge_enabled": "is_auto_recharge_enabled",
    "gen_lb02_suppression_reason": "suppression_reason_code", "gen_lb02_local_hour": "local_hour",
    "gen_lb02_hours_since_recharge": "hours_since_last_recharge", "gen_lb02_last_recharge_ts": "last_recharge_timestamp",
    "gen_lb02_pending_txn_id": "pending_txn_id", "gen_lb02_alerts_sent": "alerts_sent_last_24h",
    "gen_lb02_last_outbound_ts": "last_outbound_timestamp", "gen_lb02_decision_action": "decision_engine_action",
    "gen_lb02_journey_state": "journey_state", "gen_lb02_subsequent_ts": "subsequent_topup_timestamp",
    "gen_lb02_subsequent_channel": "subsequent_channel", "gen_lb02_subsequent_payment": "subsequent_payment",
    "gen_lb02_subsequent_amount": "subsequent_recharge_amount", "gen_lb02_balance_after": "balance_after",
}


def chain_sql(column: str) -> str:
    """Nested selects up to the column, one per step."""
    inner = "SELECT c_custkey FROM customer"
    for name, expression in STEPS:
        inner = f"SELECT *, {expression} AS {name} FROM ({inner})"
        if name == column:
            break
    return f"SELECT c_custkey, {column} FROM ({inner})"


def _register(name: str, column: str) -> None:
    def run(spark, sf_dir):
        base = table(spark, sf_dir, "customer").select(KEY)
        return synthesize(base, KEY, suppression_catalog(), PORTABLE, fields=[column]).select(KEY, column)

    query(name, chain_sql(column))(run)


for _name, _column in CHECKED.items():
    _register(_name, _column)
