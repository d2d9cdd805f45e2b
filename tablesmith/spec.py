"""Declarative table specs.

A spec is small configuration held on the driver. It is turned into Columns before any
job starts; nothing here touches data.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# Declared type vocabulary.
SPARK_TYPES = {
    "string": T.StringType(),
    "categorical": T.StringType(),
    "int": T.LongType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "number": T.DoubleType(),
    "double": T.DoubleType(),
    "decimal": T.DecimalType(18, 2),
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "datetime": T.TimestampNTZType(),
    "timestamp": T.TimestampNTZType(),
    "date": T.DateType(),
}
INTEGER_TYPES = {"int", "integer"}
NUMERIC_TYPES = {"int", "integer", "float", "number", "double", "decimal"}
BOOLEAN_TYPES = {"bool", "boolean"}
TEXT_TYPES = {"string", "categorical"}
FORMULA_FUNCTIONS = {"round", "min", "max", "abs"}

# Columns every event row gets from its place in the history, whatever the catalog says about them.
STRUCTURAL = {"journey_id", "transaction_id", "event_type", "event_sequence", "event_occurrence"}

# Parameters whose value is the name of another column.
REFERENCE_PARAMS = ("source_field", "base_field", "hi_field", "add_seconds_field", "segment_field", "field")

# Generators that are fixed combinations of others: name -> {"gen": ..., "params": ...}.
COMPOSITES: dict[str, dict] = {}


def names_in(text: str | None) -> set[str]:
    """Column names an expression string refers to."""
    if not text:
        return set()
    return {n.id for n in ast.walk(ast.parse(text.strip(), mode="eval")) if isinstance(n, ast.Name)} - FORMULA_FUNCTIONS


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    dtype: str = "string"
    gen: str = "constant"
    params: dict = field(default_factory=dict)
    depends_on: tuple[str, ...] = ()
    nullable: bool = False
    formula: str | None = None
    description: str = ""

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.dtype]

    def inputs(self) -> set[str]:
        """Declared dependencies plus the columns named by parameters and the formula."""
        found = set(self.depends_on) | names_in(self.formula)
        found |= _param_inputs(self.params)
        if self.gen == "tx_id":
            found.add("event_timestamp")
        if self.gen == "segment_range":
            found.add(self.params.get("segment_field", "subscriber_segment"))
        if self.gen in COMPOSITES:
            found |= _param_inputs(COMPOSITES[self.gen]["params"])
        return found - {self.name}


def _param_inputs(params: dict) -> set[str]:
    found: set[str] = set()
    for name, value in params.items():
        if name in REFERENCE_PARAMS and isinstance(value, str):
            found.add(value)
        elif name == "when":
            found |= names_in(value)
        elif name in ("then", "otherwise") and isinstance(value, dict):
            found |= _param_inputs(value.get("params", {})) | names_in(value.get("formula"))
    return found


@dataclass(frozen=True)
class EventSpec:
    event_type: str
    sequence: int
    fields: tuple[str, ...] = ()
    min_occurrences: int = 1
    max_occurrences: int = 10

    def clamped(self) -> EventSpec:
        low = max(1, int(self.min_occurrences))
        return replace(self, min_occurrences=low, max_occurrences=max(low, int(self.max_occurrences)))


@dataclass(frozen=True)
class EdgeCase:
    name: str
    condition: str
    overrides: tuple[ColumnSpec, ...] = ()
    event_type: str | None = None
    description: str = ""


@dataclass(frozen=True)
class Spec:
    columns: tuple[ColumnSpec, ...]
    events: tuple[EventSpec, ...] = ()
    edge_cases: tuple[EdgeCase, ...] = ()
    edge_fraction: float = 0.0
    entity_key: str | None = None

    def __post_init__(self):
        names = [c.name for c in self.columns]
        repeated = sorted({n for n in names if names.count(n) > 1})
        if repeated:
            raise ValueError(f"columns declared twice: {repeated}")
        if self.entity_key is not None and self.entity_key not in names:
            raise ValueError(f"entity key {self.entity_key!r} is not a declared column")

    def __contains__(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    def column(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def formulas(self) -> dict[str, str]:
        return {c.name: c.formula for c in self.columns if c.formula}

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, c.nullable) for c in self.columns])

    def closure(self, wanted: Iterable[str]) -> list[str]:
        """The wanted columns and everything they need, in catalog order."""
        need: set[str] = set()
        frontier = set(wanted) & set(self.names)
        while frontier:
            need |= frontier
            frontier = {i for n in frontier for i in self.column(n).inputs() if i in self} - need
        return [n for n in self.names if n in need]

    def levels(self, wanted: Iterable[str], given: Iterable[str] = ()) -> list[list[str]]:
        """Split the wanted columns into stages, each using only earlier stages."""
        todo, done, stages = list(wanted), set(given), []
        while todo:
            ready = [n for n in todo if not ({i for i in self.column(n).inputs() if i in self} - done)]
            if not ready:
                raise ValueError(f"circular dependency among {todo}")
            stages.append(ready)
            done |= set(ready)
            todo = [n for n in todo if n not in done]
        return stages

    def entity_fields(self) -> list[str]:
        """Columns owned by no event, the entity key, and what those depend on. Structural columns are made per event row."""
        owned = {f for e in self.events for f in e.fields} | STRUCTURAL
        stable = (set(self.names) - owned) | ({self.entity_key} if self.entity_key else set())
        return self.closure(stable)

    def event_fields(self, event_type: str) -> list[str]:
        event = next(e for e in self.events if e.event_type == event_type)
        return [f for f in event.fields if f in self]

    def with_columns(self, changed: dict[str, ColumnSpec]) -> Spec:
        return replace(self, columns=tuple(changed.get(c.name, c) for c in self.columns))


def with_rule_formulas(spec: Spec, rules: dict[str, str]) -> Spec:
    """A rule formula replaces any generator that is not already a formula."""
    changed = {
        c.name: replace(c, gen="formula", formula=rules[c.name])
        for c in spec.columns
        if c.name in rules and c.gen != "formula"
    }
    return spec.with_columns(changed)


def formula_table(spec: Spec, rules: dict[str, str] | None = None) -> dict[str, str]:
    """All formulas to enforce: the column's own formula first, then rules for other columns."""
    return {**(rules or {}), **spec.formulas}


def declared_constraints(spec: Spec, explicit: dict[str, dict] | None = None) -> dict[str, dict]:
    """Constraints read off declared choices and bounds; explicit entries win."""
    out = {}
    for c in spec.columns:
        base = {}
        if "choices" in c.params:
            base["valid_values"] = list(c.params["choices"])
        base.update({b: c.params[b] for b in ("min", "max") if b in c.params})
        base.update((explicit or {}).get(c.name, {}))
        if base:
            out[c.name] = base
    return out


def resolve_entity_key(requested: str | None, names: list[str], canonical: str) -> str:
    """The requested key if it is a column, else the canonical identifier, else the first column."""
    if requested in names:
        return requested
    if canonical in names:
        return canonical
    if not names:
        raise ValueError("a keyed table needs at least one column")
    return names[0]
