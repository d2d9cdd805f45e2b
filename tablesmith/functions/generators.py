"""Value generators: each builds one Column from a column spec.

``register_generator`` adds a builder to the table. An unknown generator is an error both when a
definition is loaded and when it is built.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions import expressions as X
from tablesmith.functions import profiles as P
from tablesmith.functions import values as V
from tablesmith.functions.draws import SPAN, Draws, permutation
from tablesmith.spec import COMPOSITES, ColumnSpec


@dataclass(frozen=True)
class Context:
    """What a builder may use: the column spec, its draws, and the columns made before it."""

    column: ColumnSpec
    draws: Draws
    lookup: X.Lookup
    as_of: datetime
    integral_key: bool = True
    profile: P.Profile | None = None

    @property
    def params(self) -> dict:
        return self.column.params

    def number(self, *names: str, default: float | None = None) -> float | None:
        """First given parameter that reads as a finite number."""
        value = next((self.params[n] for n in names if self.params.get(n) is not None), None)
        number = X._literal_number(value)
        return default if number is None else number

    def field(self, name: str | None, default: Column | None = None) -> Column | None:
        found = self.lookup(name) if name else None
        return default if found is None else found[0]

    def moment(self, name: str | None) -> Column:
        """A timestamp column; the job's reference time stands in for a missing one."""
        now = F.lit(self.as_of).cast("timestamp_ntz")
        found = self.field(name)
        return now if found is None else F.coalesce(found.cast("timestamp_ntz"), now)

    def nested(self, definition: dict, tag: str) -> Column:
        """Build a generator given inside another one's parameters, on its own draws."""
        column = replace(
            self.column, gen=definition["gen"], params=definition.get("params", {}), formula=definition.get("formula")
        )
        return build(replace(self, column=column, draws=replace(self.draws, field=f"{self.draws.field}/{tag}")))


Builder = Callable[[Context], Column]
GENERATORS: dict[str, Builder] = {}


def register_generator(name: str, builder: Builder) -> None:
    GENERATORS[name] = builder


def generator(name: str) -> Callable[[Builder], Builder]:
    def add(builder: Builder) -> Builder:
        register_generator(name, builder)
        return builder

    return add


def known_generators() -> set[str]:
    return set(GENERATORS)


def build(context: Context) -> Column:
    name = context.column.gen
    if name not in GENERATORS:
        raise ValueError(f"column {context.column.name!r}: unknown generator {name!r}")
    return GENERATORS[name](context)


# Identifiers


@generator("prefixed_int")
def prefixed_int(ctx: Context) -> Column:
    """Prefix and a number of d digits, more for keys past 9 * 10^(d-1). Integer keys are permuted, so ids are unique by construction."""
    digits = int(ctx.params["digits"])
    low, size = 10 ** (digits - 1), 9 * 10 ** (digits - 1)
    if ctx.integral_key:
        if digits > 15:
            raise ValueError("prefixed_int supports up to 15 digits")
        a, b = permutation(ctx.draws.seed, ctx.draws.field, size)
        key = ctx.draws.key.cast("bigint")
        # Keys beyond the declared digits get longer numbers: the key's block of ids in front, then a number of the block.
        block = F.call_function("div", key, F.lit(size))
        number = F.lit(low) + (F.pmod(key, F.lit(size)) * a + b) % size
        number = F.when(key < 0, F.raise_error(F.concat(F.lit(f"{ctx.column.name}: negative key: "), key.cast("string"))).cast("string")).otherwise(
            F.concat(F.when(block > 0, block.cast("string")).otherwise(""), number.cast("string")))
    elif size <= 1 << 31:
        number = ctx.draws.between(low, low + size - 1)
    else:
        number = F.lit(low) + F.pmod(ctx.draws.u32(0) * (1 << 31) + F.shiftright(ctx.draws.u32(1), 1), F.lit(size))
    return F.concat(F.lit(ctx.params["prefix"]), number.cast("string"))


@generator("id_mirror")
def id_mirror(ctx: Context) -> Column:
    source = ctx.field(ctx.params["source_field"], F.lit(""))
    return F.concat(F.lit(ctx.params["prefix"]), F.replace(source, F.lit(ctx.params["source_prefix"]), F.lit("")))


@generator("prefixed_uuid")
def prefixed_uuid(ctx: Context) -> Column:
    """8-4-4-4-12 hex text whose first characters are replaced by the prefix."""
    digits, prefix = ctx.draws.hex(), ctx.params["prefix"]
    parts = [F.substring(digits, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit(prefix), F.substring(F.concat_ws("-", *parts), len(prefix) + 1, 36))


@generator("tx_id")
def tx_id(ctx: Context) -> Column:
    day = F.date_format(ctx.moment("event_timestamp"), "yyyyMMdd")
    number = ctx.draws.between(1_000_000, 9_999_999)
    return F.concat(F.lit(ctx.params["prefix"]), day, F.lit("-"), number.cast("string"))


@generator("e164_phone")
def e164_phone(ctx: Context) -> Column:
    """Mobile number under the national plan of a drawn country code."""
    d, codes = ctx.draws, list(ctx.params["country_codes"])

    def digits(n: int, slot: int) -> Column:
        return F.lpad(d.below(10**n, slot).cast("string"), n, "0")

    def local(code: str) -> Column:
        # Leading digits of mobile numbers.
        if code == "+91":
            return F.concat(d.between(6, 9, 1).cast("string"), digits(9, 2))
        if code == "+44":
            return F.concat(F.lit("7"), digits(9, 1))
        if code == "+971":
            leads = F.array(*[F.lit(x) for x in ("50", "52", "54", "55", "56", "58")])
            return F.concat(F.element_at(leads, (d.below(6, 1) + 1).cast("int")), digits(7, 2))
        return F.concat(*[d.between(lo, hi, s).cast("string") for lo, hi, s in ((200, 999, 1), (200, 999, 2), (1000, 9999, 3))])

    numbers = [F.concat(F.lit(code), local(code)) for code in codes]
    return pick(numbers, [1.0] * len(numbers), d.u32(0))


# Choices and constants


def pick(options: list[Column], weights: list[float], u32: Column) -> Column:
    """One of the options, by cumulative weight over a single draw."""
    if len(options) == 1:
        return options[0]
    total, running, arms = sum(weights), 0.0, []
    for option, weight in zip(options[:-1], weights):
        running += weight
        arms.append((u32 < int(round(running / total * SPAN)), option))
    return V.first_match(arms, options[-1])


def typed(value, dtype: T.DataType) -> Column:
    return F.lit(value).cast(dtype)


def choose(choices: list, weights: list, u32: Column, dtype: T.DataType) -> Column:
    if not choices:
        return typed(None, dtype)
    if len(weights) != len(choices) or sum(weights) <= 0:
        weights = [1.0] * len(choices)
    return pick([typed(c, dtype) for c in choices], [float(w) for w in weights], u32)


@generator("weighted_choice")
def weighted_choice(ctx: Context) -> Column:
    """Weighted choice; payment fields keep only methods allowed in the row's country."""
    choices, weights = list(ctx.params.get("choices", [])), list(ctx.params.get("weights", []))
    u32, dtype = ctx.draws.u32(0), ctx.column.spark_type
    if ctx.profile is None or not P.is_payment_field(ctx.column.name):
        return choose(choices, weights, u32, dtype)

    def allowed(facts: dict) -> Column:
        methods = P.allowed_methods(facts)
        kept = [(c, w) for c, w in zip(choices, weights) if V.canonical_text(c) in methods]
        if kept:
            return choose([c for c, _ in kept], [w for _, w in kept], u32, dtype)
        return choose(list(facts["payment_methods"]), [], u32, dtype)

    return ctx.profile.pick(allowed)


@generator("constant")
def constant(ctx: Context) -> Column:
    """A fixed value; currency fields take the currency of the row's country."""
    if ctx.profile is not None and P.is_currency_field(ctx.column.name):
        return ctx.profile.pick(lambda facts: F.lit(facts["currency"]))
    return typed(ctx.params["value"], ctx.column.spark_type)


# Numbers


def _cents(low: float, high: float, draws: Draws) -> Column:
    """Uniform over whole cents in [low, high]; swapped bounds collapse to low."""
    first, last = round(low * 100), round(max(low, high) * 100)
    return (F.lit(first) + draws.below(last - first + 1)) / F.lit(100.0)


@generator("uniform")
def uniform(ctx: Context) -> Column:
    low = ctx.number("min", "lo", default=0.0)
    return _cents(low, ctx.number("max", "hi", default=low), ctx.draws)


@generator("int_range")
def int_range(ctx: Context) -> Column:
    low = int(ctx.number("min", "lo", default=0.0))
    return ctx.draws.between(low, max(low, int(ctx.number("max", "hi", default=low))))


@generator("uniform_bounded")
def uniform_bounded(ctx: Context) -> Column:
    """Upper bound read from another column."""
    low, spare = ctx.number("lo", "min", default=0.0), ctx.number("hi", "max", default=1.0)
    found = ctx.lookup(ctx.params.get("hi_field"))
    high = F.lit(spare) if found is None else F.coalesce(V.as_number(*found), F.lit(spare))
    first = round(low * 100)
    last = F.floor(F.greatest(F.lit(low), high) * 100 + 0.5)
    return (F.lit(first) + ctx.draws.below(last - first + 1)) / F.lit(100.0)


def normal(draws: Draws) -> Column:
    """Standard normal from two draws (Box-Muller)."""
    u, v = (draws.u32(0) + 1) / F.lit(float(SPAN)), draws.unit(1)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(6.283185307179586) * v)


def _lognormal(ctx: Context) -> tuple[Column, float, float]:
    mu, sigma = ctx.number("mu", default=0.0), ctx.number("sigma", default=1.0)
    low = ctx.number("min", "lo", default=0.0)
    return F.exp(F.lit(mu) + F.lit(sigma) * normal(ctx.draws)), low, ctx.number("max", "hi", default=low)


@generator("lognormal")
def lognormal(ctx: Context) -> Column:
    raw, low, high = _lognormal(ctx)
    return V.round_half_up(F.greatest(F.lit(low), F.least(F.lit(high), raw)), 2)


@generator("lognormal_int")
def lognormal_int(ctx: Context) -> Column:
    """Truncated first, clipped after."""
    raw, low, high = _lognormal(ctx)
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(raw).cast("double"))).cast("bigint")


@generator("beta")
def beta(ctx: Context) -> Column:
    """Beta(a, b). For whole a and b it is the a-th smallest of a+b-1 uniforms; otherwise made from two gamma values."""
    a, b = ctx.number("alpha"), ctx.number("beta")
    if a == int(a) and b == int(b) and a + b - 1 <= 64:
        draws = F.sort_array(F.array(*[ctx.draws.u32(i) for i in range(int(a + b) - 1)]))
        return V.round_half_up(F.element_at(draws, int(a)) / F.lit(float(SPAN)), 4)
    # G_a / (G_a + G_b) from logarithms, so that small shapes don't underflow.
    return V.round_half_up(1 / (1 + F.exp(_log_gamma(ctx.draws, b, 1) - _log_gamma(ctx.draws, a, 0))), 4)


GAMMA_TRIALS = 12


def _log_gamma(draws: Draws, shape: float, which: int) -> Column:
    """Logarithm of a Gamma(shape) value by squeezed rejection (Marsaglia and Tsang 2000); below 1 from shape + 1 and a power.

    A trial is taken with a probability of at least 0.95. Later trials are only drawn where the first fails; where all
    ``GAMMA_TRIALS`` fail (one value in 10^15), the value is the scale d.
    """
    d = (shape if shape >= 1 else shape + 1) - 1 / 3
    c = 1 / math.sqrt(9 * d)
    inner = lambda slot: (draws.u32(slot) + 0.5) / F.lit(float(SPAN))

    def trial(k: int) -> Column:
        slot = 3 * (GAMMA_TRIALS * which + k)
        normal = F.sqrt(-2 * F.ln(inner(slot))) * F.cos(F.lit(2 * math.pi) * inner(slot + 1))
        return F.struct((1 + c * normal).alias("t"), normal.alias("x"), inner(slot + 2).alias("u"))

    def taken(r: Column) -> Column:
        t, x = r["t"], r["x"]
        fits = (t > 0) & (F.ln(r["u"]) < 0.5 * x * x + d - d * (t * t * t) + 3 * d * F.ln(t))
        return F.when(fits, 3 * F.ln(t))

    def first_of(trials: range) -> Column:
        return F.get(F.filter(F.transform(F.array(*map(trial, trials)), taken), lambda v: v.isNotNull()), F.lit(0))

    value = F.lit(math.log(d)) + F.coalesce(first_of(range(1)), first_of(range(1, GAMMA_TRIALS)), F.lit(0.0))
    return value if shape >= 1 else value + F.ln(inner(6 * GAMMA_TRIALS + which)) / shape


@generator("segment_range")
def segment_range(ctx: Context) -> Column:
    """Range chosen by the row's segment; an unknown segment takes the first range."""
    ranges = {k: v for k, v in ctx.params.items() if isinstance(v, dict)}
    segment = ctx.field(ctx.params.get("segment_field", "subscriber_segment"), F.lit("Occasional Rechargers"))

    def draw(bounds: dict) -> Column:
        low, high = round(float(bounds["min"]) * 10000), round(float(bounds["max"]) * 10000)
        return (F.lit(low) + ctx.draws.below(max(low, high) - low + 1)) / F.lit(10000.0)

    return V.first_match([(segment == k, draw(v)) for k, v in ranges.items()], draw(next(iter(ranges.values()))))


@generator("formula")
def formula(ctx: Context) -> Column:
    return X.formula(ctx.column.formula, ctx.lookup)


# Times


def add_seconds(moment: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, moment)


@generator("recent_datetime")
def recent_datetime(ctx: Context) -> Column:
    d = ctx.draws
    back = d.below(int(ctx.params["days_back"]) + 1, 0) * 86400 + d.below(24, 1) * 3600 + d.below(60, 2) * 60 + d.below(60, 3)
    return add_seconds(F.lit(ctx.as_of).cast("timestamp_ntz"), -back)


@generator("ts_offset")
def ts_offset(ctx: Context) -> Column:
    seconds = ctx.draws.between(int(ctx.params["min_sec"]), int(ctx.params["max_sec"]))
    return add_seconds(ctx.moment(ctx.params["base_field"]), seconds)


@generator("ts_add_field")
def ts_add_field(ctx: Context) -> Column:
    seconds = ctx.field(ctx.params["add_seconds_field"])
    whole = F.lit(60) if seconds is None else F.coalesce(seconds.cast("bigint"), F.lit(60))
    return add_seconds(ctx.moment(ctx.params["base_field"]), whole)


@generator("date_offset")
def date_offset(ctx: Context) -> Column:
    return F.date_add(ctx.moment(ctx.params["base_field"]).cast("date"), int(ctx.params["days"]))


@generator("shifted_ts")
def shifted_ts(ctx: Context) -> Column:
    """Base time moved by hours: those of another column, or drawn in hundredths from a range."""
    base, sign = ctx.moment(ctx.params["base_field"]), int(ctx.params.get("sign", 1))
    if "field" in ctx.params:
        hours = F.coalesce(ctx.field(ctx.params["field"], F.lit(24.0)).cast("double"), F.lit(24.0))
        hundredths = F.floor(hours * 100 + 0.5)
    else:
        hundredths = ctx.draws.between(round(ctx.params["min_hours"] * 100), round(ctx.params["max_hours"] * 100))
    return add_seconds(base, hundredths * (36 * sign))


# Conditional values


@generator("case_of")
def case_of(ctx: Context) -> Column:
    """Map another column's value; anything unmapped takes the default."""
    source, dtype = ctx.field(ctx.params["field"], F.lit(None)), ctx.column.spark_type
    arms = [(source == k, typed(v, dtype)) for k, v in ctx.params["mapping"].items()]
    return V.first_match(arms, typed(ctx.params.get("default"), dtype))


@generator("conditional")
def conditional(ctx: Context) -> Column:
    dtype = ctx.column.spark_type
    yes, no = (ctx.nested(ctx.params[side], side).cast(dtype) for side in ("then", "otherwise"))
    return F.when(X.matches(ctx.params["when"], ctx.lookup), yes).otherwise(no)


@generator("zone_hour")
def zone_hour(ctx: Context) -> Column:
    """Hour of the base time after a fixed per-zone offset."""
    zone = ctx.field(ctx.params["field"], F.lit(None))
    arms = [(zone == k, F.lit(v)) for k, v in ctx.params["offsets"].items()]
    offset = V.first_match(arms, F.lit(ctx.params["default_offset"]))
    return F.pmod(F.hour(ctx.moment(ctx.params["base_field"])) + offset, F.lit(24)).cast("bigint")


@generator("waking_hour")
def waking_hour(ctx: Context) -> Column:
    """Local hour, replaced by a drawn one when it falls in the quiet hours."""
    hour = zone_hour(ctx)
    return F.when(hour.isin(list(ctx.params["quiet"])), int_range(ctx)).otherwise(hour)


@generator("random_int_id")
def random_int_id(ctx: Context) -> Column:
    digits = int(ctx.params["digits"])
    number = ctx.draws.between(10 ** (digits - 1), 10**digits - 1)
    return F.concat(F.lit(ctx.params["prefix"]), number.cast("string"))


@generator("sum_if_present")
def sum_if_present(ctx: Context) -> Column:
    """Base plus amount to two decimals; null without an amount, a missing base counts as 0."""
    amount = ctx.field(ctx.params["field"], F.lit(None).cast("double"))
    base = ctx.field(ctx.params["base_field"], F.lit(0.0))
    return V.round_half_up(F.coalesce(base, F.lit(0.0)) + amount, 2)


def register_composite(name: str, definition: dict) -> None:
    """Name a generator that is a fixed combination of others."""
    COMPOSITES[name] = definition
    register_generator(name, lambda ctx: ctx.nested(definition, name))
