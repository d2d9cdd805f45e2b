"""Attach generated columns to a keyed table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions import expressions as X
from tablesmith.functions import generators as G
from tablesmith.functions import values as V
from tablesmith.functions.draws import Draws
from tablesmith.functions.profiles import Profile
from tablesmith.spec import INTEGER_TYPES, NUMERIC_TYPES, ColumnSpec, Spec


@dataclass(frozen=True)
class Settings:
    """Job parameters shared by all generated columns."""

    seed: int = 0
    as_of: datetime = field(default_factory=lambda: datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0))
    mode: str = "fast"
    profile: Profile | None = None
    constraints: dict[str, dict] = field(default_factory=dict)


def column_value(column: ColumnSpec, settings: Settings, key: Column, integral_key: bool, lookup: X.Lookup,
                 attempt: Column | int = 0, tag: str = "") -> Column:
    """The Column for one spec entry, constraints applied."""
    draws = Draws(settings.seed, column.name + tag, key, attempt, settings.mode)
    value = G.build(G.Context(column, draws, lookup, settings.as_of, integral_key, settings.profile))
    value = value.cast(column.spark_type)
    rule = settings.constraints.get(column.name)
    return value if not rule else constrain(value, column, rule, draws.u32(3))


def synthesize(df: DataFrame, key: str, spec: Spec, settings: Settings = Settings(), fields: Iterable[str] | None = None,
               attempt: Column | int = 0) -> DataFrame:
    """Add the wanted spec columns (default all) and what they depend on; columns already there are kept.

    Narrow work only: one select per dependency level, no shuffle.
    """
    present = set(df.columns)
    wanted = [n for n in spec.closure(fields if fields is not None else spec.names) if n not in present]
    integral = isinstance(df.schema[key].dataType, V.INTEGRAL)
    for level in spec.levels(wanted, given=present):
        lookup = X.fields_of(df)
        made = [column_value(spec.column(n), settings, F.col(key), integral, lookup, attempt).alias(n) for n in level]
        df = df.select("*", *made)
    return df


def synthesize_range(spark: SparkSession, n: int, spec: Spec, settings: Settings = Settings()) -> DataFrame:
    """n generated rows keyed by unit_id 0..n-1."""
    return synthesize(spark.range(n).withColumnRenamed("id", "unit_id"), "unit_id", spec, settings)


# Constraints


def listed(value) -> list:
    """A list, or text holding one split on the first of | ; , that occurs."""
    if isinstance(value, (list, tuple, set)):
        return list(value)
    text = value.strip() if isinstance(value, str) else ""
    mark = next((m for m in "|;," if m in text), None)
    parts = text.split(mark) if mark else [text]
    return [p.strip() for p in parts if p.strip()]


def constrain(value: Column, column: ColumnSpec, rule: dict, u32: Column) -> Column:
    """Keep a value inside its rule.

    Listed values: a match ignoring case, spaces and hyphens takes the listed spelling, anything else is
    drawn from the list. Otherwise numbers are clamped, floats to two decimals. Null stays null.
    """
    allowed = listed(rule.get("preferred_values")) or listed(rule.get("valid_values"))
    if allowed:
        options = [G.typed(a, column.spark_type) for a in allowed]
        if column.dtype in NUMERIC_TYPES:
            arms = [(value == option, option) for option in options]
        else:
            norm = V.canonical(value.cast("string"))
            arms = [(norm == V.canonical_text(a), option) for a, option in zip(allowed, options)]
        return F.when(value.isNotNull(), V.first_match(arms, G.choose(allowed, [], u32, column.spark_type)))
    if column.dtype not in NUMERIC_TYPES or not {"min", "max"} & set(rule):
        return value
    bounded = V.clamp(value, *[None if rule.get(b) is None else float(rule[b]) for b in ("min", "max")])
    return bounded.cast(column.spark_type) if column.dtype in INTEGER_TYPES else V.round_half_up(bounded, 2)


# Formulas on existing columns


def add_formulas(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Compute formula columns from the columns present, each after its inputs, in one pass over the data."""
    for name in X.formula_order(formulas):
        df = df.withColumn(name, X.formula(formulas[name], X.fields_of(df)))
    return df
