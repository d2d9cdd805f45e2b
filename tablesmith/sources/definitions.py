"""Scenario definitions from CSV files.

Two layouts: columns only, and typed rows (``record_type`` = variable, event, edge_case_variable or metadata).
Definitions are configuration: they are read with Spark's CSV reader, checked, and held on the driver.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tablesmith.functions import expressions as X
from tablesmith.functions.generators import known_generators
from tablesmith.spec import ColumnSpec, EdgeCase, EventSpec, Spec, names_in

# Accepted vocabulary of definition files.
DTYPES = {"string", "int", "float", "categorical", "datetime", "date", "bool", "boolean"}
RECORD_TYPES = {"variable", "event", "edge_case_variable", "metadata"}
TRUE_STRINGS = {"true", "1", "yes", "y"}
MAX_DEFINITION_ROWS = 100_000


def _read(spark: SparkSession, path: str) -> list[dict[str, str]]:
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True,
                          ignoreTrailingWhiteSpace=True, enforceSchema=False)
    names = [c.strip().lstrip("﻿").lower() for c in rows.columns]
    if len(names) != len(set(names)):
        raise ValueError("definition has duplicate column names")
    rows = rows.toDF(*names).select(*[F.coalesce(F.trim(n), F.lit("")).alias(n) for n in names])
    found = rows.limit(MAX_DEFINITION_ROWS + 1).collect()
    if len(found) > MAX_DEFINITION_ROWS:
        raise ValueError(f"definition has more than {MAX_DEFINITION_ROWS} rows; is it a data file?")
    if not found:
        raise ValueError("definition has no rows")
    return [r.asDict() for r in found]


def _names(text: str) -> tuple[str, ...]:
    return tuple(p.strip() for p in re.split(r"[;|,]", text or "") if p.strip())


def _column(row: dict, known: dict[str, ColumnSpec], inherit: bool = False) -> ColumnSpec:
    name = row.get("name", "")
    if not name:
        raise ValueError("a variable row has no name")
    base = known.get(name) if inherit else None
    dtype = (row.get("dtype") or (base.dtype if base else "")).lower()
    gen = row.get("gen") or (base.gen if base else "")
    if dtype not in DTYPES:
        raise ValueError(f"{name}: unknown dtype {dtype!r}")
    if gen not in known_generators():
        raise ValueError(f"{name}: unknown generator {gen!r}")
    depends = _names(row.get("depends_on", "")) or (base.depends_on if base else ())
    late = [d for d in depends if d not in known]
    if late:
        raise ValueError(f"{name}: depends_on {late} must be defined in an earlier row")
    text = row.get("params", "")
    try:
        params = json.loads(text) if text else dict(base.params) if base else {}
    except json.JSONDecodeError as error:
        raise ValueError(f"{name}: params is not valid JSON: {error}") from error
    if not isinstance(params, dict):
        raise ValueError(f"{name}: params must be a JSON object")
    formula = None
    if gen == "formula":
        formula = row.get("formula") or (base.formula if base else None)
        if not formula:
            raise ValueError(f"{name}: generator formula needs a formula")
    return ColumnSpec(name, "boolean" if dtype == "bool" else dtype, gen, params, depends,
                      row.get("nullable", "").lower() in TRUE_STRINGS, formula, row.get("description", ""))


def load_columns(spark: SparkSession, path: str) -> Spec:
    """Columns-only layout: one variable per row, row order is catalog order."""
    known: dict[str, ColumnSpec] = {}
    rows = _read(spark, path)
    missing = {"name", "dtype", "gen"} - set(rows[0])
    if missing:
        raise ValueError(f"definition lacks columns {sorted(missing)}")
    for row in rows:
        column = _column(row, known)
        if column.name in known:
            raise ValueError(f"duplicate variable {column.name!r}")
        known[column.name] = column
    return Spec(tuple(known.values()))


def load_spec(spark: SparkSession, path: str, entity_key: str | None = None, edge_fraction: float | None = None) -> Spec:
    """Typed-row layout. An entity key makes it an event scenario, which needs at least one event row."""
    rows = _read(spark, path)
    if "record_type" not in rows[0]:
        raise ValueError("definition lacks column 'record_type'")
    known: dict[str, ColumnSpec] = {}
    events: list[EventSpec] = []
    cases: dict[str, EdgeCase] = {}
    fraction = 0.0
    for row in rows:
        kind = row["record_type"].lower()
        if kind not in RECORD_TYPES:
            raise ValueError(f"unknown record_type {row['record_type']!r}")
        if kind == "variable":
            column = _column(row, known)
            if column.name in known:
                raise ValueError(f"duplicate variable {column.name!r}")
            known[column.name] = column
        elif kind == "edge_case_variable":
            _add_case(row, known, cases)
        elif kind == "event":
            events.append(_event(row, len(events) + 1))
        else:
            fraction = _fraction(row, fraction)
    if not known:
        raise ValueError("definition has no variable row")
    if events and entity_key is None:
        raise ValueError("event rows need an entity key")
    if entity_key is not None and not events:
        raise ValueError("an event scenario needs at least one event row")
    for case in cases.values():
        undeclared = names_in(case.condition) - set(known)
        if undeclared:
            raise ValueError(f"condition {case.condition!r} refers to undeclared variables {sorted(undeclared)}")
    chosen = fraction if edge_fraction is None else edge_fraction
    if not math.isfinite(chosen) or not 0.0 <= chosen <= 1.0:
        raise ValueError("edge case percentage must be between 0 and 1")
    return Spec(tuple(known.values()), _numbered(events, known), tuple(cases.values()), chosen if cases else 0.0, entity_key)


def _add_case(row: dict, known: dict[str, ColumnSpec], cases: dict[str, EdgeCase]) -> None:
    column = _column(row, known, inherit=True)
    known.setdefault(column.name, column)
    name, condition = row.get("edge_case_name", ""), row.get("condition", "")
    if not name or not condition:
        raise ValueError(f"{column.name}: an edge case needs edge_case_name and condition")
    if X.parse_condition(condition) is None:
        raise ValueError(f"{column.name}: condition {condition!r} is not supported")
    scope = row.get("event_type", "").upper().replace(" ", "_") or None
    have = cases.get(name, EdgeCase(name, condition, (), scope, row.get("edge_case_description", "")))
    cases[name] = EdgeCase(name, have.condition, (*have.overrides, column), have.event_type or scope, have.description)


def _event(row: dict, position: int) -> EventSpec:
    kind = (row.get("event_type") or row.get("name", "")).upper().replace(" ", "_")
    if not kind:
        raise ValueError("an event row needs event_type")
    sequence = int(row.get("sequence") or position)
    if sequence < 1:
        raise ValueError(f"{kind}: sequence must be at least 1")
    low, high = int(row.get("min_occurrences") or 1), int(row.get("max_occurrences") or 10)
    return EventSpec(kind, sequence, _names(row.get("fields", "")), low, high).clamped()


def _fraction(row: dict, before: float) -> float:
    text = row.get("edge_case_percentage", "")
    if not text and row.get("name", "").lower() in ("edgecasepercentage", "edge_case_percentage"):
        text = row.get("value", "")
    if not text:
        return before
    value = float(text)
    if not math.isfinite(value) or not 0.0 <= value <= 1.0:
        raise ValueError("edge case percentage must be between 0 and 1")
    return value


def _numbered(events: list[EventSpec], known: dict[str, ColumnSpec]) -> tuple[EventSpec, ...]:
    kinds = [e.event_type for e in events]
    repeated = sorted({k for k in kinds if kinds.count(k) > 1})
    if repeated:
        raise ValueError(f"duplicate event types {repeated}")
    for e in events:
        undeclared = [f for f in e.fields if f not in known]
        if undeclared:
            raise ValueError(f"event {e.event_type!r} refers to undeclared variables {undeclared}")
    ordered = sorted(events, key=lambda e: (e.sequence, e.event_type))
    return tuple(EventSpec(e.event_type, i, e.fields, e.min_occurrences, e.max_occurrences) for i, e in enumerate(ordered, 1))
