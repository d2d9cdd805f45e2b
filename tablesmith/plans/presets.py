"""Ready-made specs: a full prepaid low-balance catalog, a suppression catalog, and two small samples."""

from __future__ import annotations

from tablesmith.functions.generators import register_composite
from tablesmith.spec import ColumnSpec, EdgeCase, EventSpec, Spec


def _choice(name: str, options: dict, dtype: str = "categorical") -> ColumnSpec:
    return ColumnSpec(name, dtype, "weighted_choice", {"choices": list(options), "weights": list(options.values())})


def _fixed(name: str, value, dtype: str = "categorical") -> ColumnSpec:
    return ColumnSpec(name, dtype, "constant", {"value": value})


def low_balance_catalog() -> Spec:
    """35 columns of a prepaid subscriber who is offered and accepts a recharge."""
    # Columns, vocabularies, weights and bounds.
    return Spec(entity_key="subscriber_id", columns=(
        ColumnSpec("subscriber_id", "string", "prefixed_int", {"prefix": "SUB-", "digits": 7}),
        ColumnSpec("subscriber_msisdn", "string", "e164_phone", {"country_codes": ["+1"]}),
        ColumnSpec("account_id", "string", "id_mirror",
                   {"prefix": "ACC-PRE-", "source_field": "subscriber_id", "source_prefix": "SUB-"}),
        _choice("subscriber_segment", {"Habitual Rechargers": 0.55, "Occasional Rechargers": 0.30, "Valued Customers": 0.15}),
        _choice("rate_plan_code", {"PRE_FLEX_TALK_30D": 0.35, "PRE_UNLIMITED_28D": 0.30, "PRE_LONG_VAL_84D": 0.15,
                                   "PRE_DATA_BOOSTER_DAILY": 0.10, "PRE_ANNUAL_365D": 0.10}),
        _fixed("wallet_currency", "USD", "string"),
        ColumnSpec("customer_lifetime_value", "float", "lognormal", {"mu": 5.5, "sigma": 0.8, "min": 25.0, "max": 2500.0}),
        ColumnSpec("churn_propensity_score", "float", "beta", {"alpha": 2, "beta": 5}),
        _choice("loyalty_tier_customer", {"Bronze": 0.40, "Silver": 0.30, "Gold": 0.20, "Platinum": 0.10}),
        ColumnSpec("avg_daily_spend_trailing_30d", "float", "uniform", {"min": 0.5, "max": 50.0}),
        ColumnSpec("dynamic_lb_threshold_pct", "float", "segment_range", {
            "Habitual Rechargers": {"min": 100.0, "max": 150.0}, "Occasional Rechargers": {"min": 150.0, "max": 200.0},
            "Valued Customers": {"min": 200.0, "max": 300.0}}),
        ColumnSpec("low_balance_threshold_amt", "float", "formula", formula=(
            "round(min(15.0, max(0.5, avg_daily_spend_trailing_30d * (dynamic_lb_threshold_pct / 100))), 2)")),
        ColumnSpec("balance_before", "float", "uniform_bounded", {"lo": 0.0, "hi_field": "low_balance_threshold_amt"}),
        _choice("days_since_last_recharge", {7: 0.08, 10: 0.05, 14: 0.07, 21: 0.07, 28: 0.28, 30: 0.23, 60: 0.07, 84: 0.12,
                                             90: 0.03}, "int"),
        ColumnSpec("trigger_event_id", "string", "prefixed_uuid", {"prefix": "trig-"}),
        ColumnSpec("event_timestamp", "datetime", "recent_datetime", {"days_back": 90}),
        _choice("trigger_type", {"LOW_BALANCE_THRESHOLD_BREACH": 0.70, "VALIDITY_EXPIRY_WARNING": 0.20, "ZERO_BALANCE": 0.10}),
        _choice("nba_offer_id", {"TOPUP_BUNDLE_PROMO_20": 0.40, "TOPUP_BUNDLE_PROMO_10": 0.30, "TOPUP_VALUE_PACK_50": 0.15,
                                 "TOPUP_SACHET_BOOSTER_05": 0.10, "TOPUP_RECHARGE_ANNUAL_200": 0.05}),
        _choice("recommended_topup_amt", {5.0: 0.15, 10.0: 0.30, 20.0: 0.40, 50.0: 0.15}, "float"),
        ColumnSpec("incentive_bonus_credit", "float", "uniform", {"min": 0.0, "max": 5.0}),
        _choice("outreach_channel", {"APP_PUSH": 0.40, "SMS": 0.30, "RCS": 0.15, "WHATSAPP": 0.15}),
        ColumnSpec("notification_dispatch_ts", "datetime", "ts_offset",
                   {"base_field": "event_timestamp", "min_sec": 1, "max_sec": 10}),
        _choice("channel_delivery_status", {"DELIVERED": 0.60, "READ": 0.36, "SENT": 0.03, "FAILED": 0.01}),
        _fixed("customer_action", "ACCEPTED"),
        ColumnSpec("response_time_seconds", "int", "lognormal_int", {"mu": 5.5, "sigma": 1.2, "min": 10, "max": 86400}),
        ColumnSpec("customer_response_ts", "datetime", "ts_add_field",
                   {"base_field": "notification_dispatch_ts", "add_seconds_field": "response_time_seconds"}),
        _choice("recharge_channel", {"MY_ACCOUNT_APP": 0.50, "RCS_LINK": 0.30, "USSD": 0.10, "WEB_PORTAL": 0.10}),
        _choice("payment_method", {"DIRECT_PAY": 0.40, "CREDIT_CARD": 0.25, "DEBIT_CARD": 0.20, "DIGITAL_WALLET": 0.15}),
        ColumnSpec("payment_gateway_tx_id", "string", "tx_id", {"prefix": "PG-TXN-"}),
        ColumnSpec("recharge_amount", "float", "formula", formula="recommended_topup_amt"),
        _fixed("transaction_status", "SUCCESS"),
        ColumnSpec("balance_after", "float", "formula", formula="round(balance_before + recharge_amount, 2)"),
        ColumnSpec("balance_expiry_date_new", "date", "date_offset", {"base_field": "event_timestamp", "days": 30}),
        _fixed("journey_state_final", "COMPLETED_SUCCESS"),
        _fixed("ocs_ledger_sync_status", "SYNCHRONIZED"),
    ))


def _when(condition: str, then: dict, otherwise: dict) -> dict:
    return {"gen": "conditional", "params": {"when": condition, "then": then, "otherwise": otherwise}}


def _pick(options: dict) -> dict:
    return {"gen": "weighted_choice", "params": {"choices": list(options), "weights": list(options.values())}}


def _value(value) -> dict:
    return {"gen": "constant", "params": {"value": value}}


# Suppression rules, zones, vocabularies and weights.
REASON, ATTRIBUTION = "suppression_reason_code", "campaign_attribution_nature"
QUIET_HOURS = [21, 22, 23, 0, 1, 2, 3, 4, 5, 6]
NO_TOPUP = "subsequent_topup_timestamp is None"
ZONES = {"US_EAST_NY": "America/New_York", "US_WEST_CA": "America/Los_Angeles", "US_CENTRAL_TX": "America/Chicago",
         "US_SOUTH_FL": "America/New_York"}
ZONE_OFFSETS = {"America/New_York": -4, "America/Los_Angeles": -7, "America/Chicago": -5}
REASONS = {"RECENT_RECHARGE_COOLDOWN": 0.40, "PENDING_IN_FLIGHT_TXN": 0.20, "FREQUENCY_CAP_EXCEEDED": 0.20,
           "AUTO_RECHARGE_ACTIVE": 0.10, "QUIET_HOURS_RESTRICTION": 0.10}
SUPPRESSION_GENERATORS = {
    "circle_tz_lookup": {"gen": "case_of", "params": {
        "field": "telecom_circle_code", "mapping": ZONES, "default": "America/New_York"}},
    "lb02_auto_recharge_enabled": _when(
        'auto_recharge_mandate_status in ["PROCESSING_IN_FLIGHT", "ACTIVE_IDLE"]', _value(True),
        _pick({False: 0.85, True: 0.15})),
    "lb02_suppression_reason": _when(
        'auto_recharge_mandate_status == "PROCESSING_IN_FLIGHT"', _value("AUTO_RECHARGE_ACTIVE"), _pick(REASONS)),
    "lb02_local_hour": _when(
        f'{REASON} == "QUIET_HOURS_RESTRICTION"', {"gen": "weighted_choice", "params": {"choices": QUIET_HOURS}},
        {"gen": "waking_hour", "params": {
            "field": "subscriber_local_tz", "base_field": "event_timestamp", "offsets": ZONE_OFFSETS, "default_offset": -4,
            "quiet": QUIET_HOURS, "min": 7, "max": 20}}),
    "lb02_hours_since_recharge": _when(
        f'{REASON} == "RECENT_RECHARGE_COOLDOWN"', {"gen": "uniform", "params": {"min": 0.25, "max": 23.99}},
        {"gen": "uniform", "params": {"min": 24.01, "max": 720.0}}),
    "lb02_last_recharge_ts": {"gen": "shifted_ts", "params": {
        "base_field": "event_timestamp", "field": "hours_since_last_recharge", "sign": -1}},
    "lb02_pending_txn_id": _when(
        f'{REASON} == "PENDING_IN_FLIGHT_TXN"', {"gen": "random_int_id", "params": {"prefix": "TXN-PG-", "digits": 9}},
        _value(None)),
    "lb02_alerts_sent": _when(
        f'{REASON} == "FREQUENCY_CAP_EXCEEDED"', {"gen": "int_range", "params": {"min": 1, "max": 3}}, _value(0)),
    "lb02_last_outbound_ts": _when(
        "alerts_sent_last_24h == 0", _value(None),
        {"gen": "shifted_ts", "params": {"base_field": "event_timestamp", "min_hours": 0.5, "max_hours": 23.5, "sign": -1}}),
    "lb02_decision_action": {"gen": "case_of", "params": {"field": REASON, "default": "DROPPED", "mapping": {
        "QUIET_HOURS_RESTRICTION": "QUEUED_FOR_MORNING", "RECENT_RECHARGE_COOLDOWN": "SUPPRESSED_SILENT",
        "AUTO_RECHARGE_ACTIVE": "SUPPRESSED_SILENT"}}},
    "lb02_journey_state": {"gen": "case_of", "params": {
        "field": "decision_engine_action", "mapping": {"QUEUED_FOR_MORNING": "DEFERRED_PENDING"},
        "default": "CLOSED_SUPPRESSED"}},
    "lb02_subsequent_ts": _when(
        f'{ATTRIBUTION} == "UNCONVERTED"', _value(None),
        {"gen": "shifted_ts", "params": {"base_field": "event_timestamp", "min_hours": 0.5, "max_hours": 48.0}}),
    "lb02_subsequent_channel": _when(NO_TOPUP, _value(None), _when(
        f'{ATTRIBUTION} == "AUTO_RECURRING"', _value("AUTO_DEBIT_ACH"),
        _pick({"MY_ACCOUNT_APP": 0.60, "RETAILER_POS": 0.25, "WEB_PORTAL": 0.15}))),
    "lb02_subsequent_payment": _when(NO_TOPUP, _value(None), _when(
        f'{ATTRIBUTION} == "AUTO_RECURRING"', _value("DIRECT_DEBIT"),
        _pick({"CREDIT_CARD": 0.40, "DEBIT_CARD": 0.35, "DIGITAL_WALLET": 0.25}))),
    "lb02_subsequent_amount": _when(NO_TOPUP, _value(None), _pick({10.0: 0.30, 20.0: 0.50, 50.0: 0.20})),
    "lb02_balance_after": {"gen": "sum_if_present", "params": {
        "field": "subsequent_recharge_amount", "base_field": "balance_before"}},
}
for _name, _definition in SUPPRESSION_GENERATORS.items():
    register_composite(_name, _definition)


def suppression_catalog() -> Spec:
    """Low-balance alerts that are held back, and what the subscriber did afterwards."""
    made = lambda name, dtype, gen: ColumnSpec(name, dtype, gen)
    return Spec(columns=(
        _choice("telecom_circle_code", {**dict.fromkeys(ZONES, 1.0), "US_OTHER": 1.0}),
        _choice("auto_recharge_mandate_status", {"PROCESSING_IN_FLIGHT": 0.1, "ACTIVE_IDLE": 0.2, "NONE": 0.7}),
        _choice(ATTRIBUTION, {"UNCONVERTED": 0.4, "AUTO_RECURRING": 0.2, "ORGANIC": 0.4}),
        ColumnSpec("event_timestamp", "datetime", "recent_datetime", {"days_back": 30}),
        ColumnSpec("balance_before", "float", "uniform", {"min": 0.0, "max": 15.0}),
        made("subscriber_local_tz", "string", "circle_tz_lookup"),
        made("is_auto_recharge_enabled", "boolean", "lb02_auto_recharge_enabled"),
        made(REASON, "categorical", "lb02_suppression_reason"),
        made("local_hour", "int", "lb02_local_hour"),
        made("hours_since_last_recharge", "float", "lb02_hours_since_recharge"),
        made("last_recharge_timestamp", "datetime", "lb02_last_recharge_ts"),
        made("pending_txn_id", "string", "lb02_pending_txn_id"),
        made("alerts_sent_last_24h", "int", "lb02_alerts_sent"),
        made("last_outbound_timestamp", "datetime", "lb02_last_outbound_ts"),
        made("decision_engine_action", "categorical", "lb02_decision_action"),
        made("journey_state", "categorical", "lb02_journey_state"),
        made("subsequent_topup_timestamp", "datetime", "lb02_subsequent_ts"),
        made("subsequent_channel", "categorical", "lb02_subsequent_channel"),
        made("subsequent_payment", "categorical", "lb02_subsequent_payment"),
        made("subsequent_recharge_amount", "float", "lb02_subsequent_amount"),
        made("balance_after", "float", "lb02_balance_after"),
    ))


def _override(name: str, value, dtype: str) -> ColumnSpec:
    return ColumnSpec(name, dtype, "constant", {"value": value})


def account_sample() -> Spec:
    """One flat record per subscriber, three edge cases, 4% of rows."""
    # Sample columns and edge cases.
    return Spec(
        columns=(
            ColumnSpec("subscriber_id", "string", "prefixed_int", {"prefix": "SUB-", "digits": 8}),
            ColumnSpec("balance", "float", "uniform", {"min": 0, "max": 500}),
            _choice("plan_type", {"prepaid": 0.7, "postpaid": 0.3}),
            _choice("account_status", {"ACTIVE": 0.8, "SUSPENDED": 0.15, "CLOSED": 0.05}),
            ColumnSpec("monthly_spend", "float", "uniform", {"min": 0, "max": 1000}),
        ),
        edge_cases=(
            EdgeCase("ZERO_BALANCE_ACCOUNT", "balance == 0", (_override("balance", 0, "float"),)),
            EdgeCase("ZERO_BALANCE_SUSPENDED", 'balance == 0 and account_status == "SUSPENDED"',
                     (_override("account_status", "SUSPENDED", "categorical"),)),
            EdgeCase("HIGH_SPEND_OUTLIER", "monthly_spend >= 1000", (_override("monthly_spend", 1000, "float"),)),
        ),
        edge_fraction=0.04,
    )


def recharge_sample() -> Spec:
    """Two events per subscriber, two edge cases on the second one, 2% of entities."""
    # Sample columns, events and edge cases.
    scope, zero = "RECHARGE_COMPLETED", 'balance_before == 0 and session_status == "TERMINATING"'
    return Spec(
        entity_key="subscriber_id",
        columns=(
            ColumnSpec("subscriber_id", "string", "prefixed_int", {"prefix": "SUB-", "digits": 8}),
            ColumnSpec("transaction_id", "string", "tx_id", {"prefix": "TXN-"}),
            ColumnSpec("event_timestamp", "datetime", "recent_datetime", {"days_back": 30}),
            ColumnSpec("balance_before", "float", "uniform", {"min": 0, "max": 100}),
            ColumnSpec("recharge_amount", "float", "uniform", {"min": 10, "max": 500}, nullable=True),
            ColumnSpec("balance_after", "float", "formula", depends_on=("balance_before", "recharge_amount"),
                       formula="balance_before + recharge_amount"),
            _choice("session_status", {"ACTIVE": 0.5, "TERMINATING": 0.2, "IDLE": 0.3}),
            _choice("payment_method_type", {"CARD": 0.5, "PAYPAL": 0.3, "BANK_TRANSFER": 0.2}),
        ),
        events=(
            EventSpec("BALANCE_LOW", 1, ("event_timestamp", "balance_before", "session_status"), 1, 3),
            EventSpec(scope, 2, ("event_timestamp", "balance_before", "recharge_amount", "balance_after", "session_status",
                                 "payment_method_type"), 1, 5),
        ),
        edge_cases=(
            EdgeCase("ZERO_BALANCE_TERMINATION", zero, (
                _override("balance_before", 0, "float"), _override("session_status", "TERMINATING", "categorical")), scope),
            EdgeCase("HIGH_VALUE_RECHARGE", "recharge_amount >= 500", (_override("recharge_amount", 500, "float"),), scope),
        ),
        edge_fraction=0.02,
    )
