"""Order conditions between columns and literals as one small system, solved on the driver.

Each condition says that a value plus a distance is at most another value. The longest distances between all pairs give
every column's tightest bounds; a positive distance from a column to itself means that the conditions contradict each
other. The solution is an expression for each column, in an order in which lower columns come first: its current value,
moved into its bounds and past the columns below it. So rows that meet the conditions keep their values.
"""

from __future__ import annotations

import ast
import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions import values as V

LOWER = {ast.Lt: True, ast.LtE: False}
UPPER = {ast.Gt: True, ast.GtE: False}
ZERO = ""  # stands for the number 0 (or the epoch), so that literals are distances from it
EPOCH = dt.datetime(1970, 1, 1)
DAY = 86_400


class Contradiction(ValueError):
    """Conditions that no values meet."""


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, V.TEMPORAL)


def amount(value, dtype: T.DataType) -> Fraction | None:
    """A literal as a number, or as seconds since the epoch; None where it can't be compared with the type."""
    if isinstance(value, bool) or value is None:
        return None
    if is_time(dtype):
        try:
            at = dt.datetime.fromisoformat(value.strip()) if isinstance(value, str) else None
        except ValueError:
            return None
        if at is None:
            return None
        if at.tzinfo is not None:
            at = at.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return Fraction((at - EPOCH) // dt.timedelta(microseconds=1), 1_000_000)
    if isinstance(dtype, V.NUMERIC) and isinstance(value, (int, float)) and value - value == 0:
        return Fraction(str(value))
    return None


def step(dtype: T.DataType, value=None) -> Fraction:
    """The distance by which a strict comparison is met: a day, a second, 1 for whole numbers, else 0.01."""
    if is_time(dtype):
        return Fraction(DAY if isinstance(dtype, T.DateType) else 1)
    return Fraction(1) if isinstance(dtype, V.INTEGRAL) or isinstance(value, int) else Fraction(1, 100)


@dataclass
class System:
    """Longest distances: ``far[a, b] = w`` means a + w <= b. ``pairs`` are those that don't go over a literal."""

    names: list[str]
    far: dict[tuple[str, str], Fraction] = field(default_factory=dict)
    pairs: dict[tuple[str, str], Fraction] = field(default_factory=dict)

    def at_least(self, a: str, w: Fraction, b: str) -> None:
        self.far[a, b] = max(w, self.far.get((a, b), w))

    def close(self) -> System:
        nodes = [*self.names, ZERO]
        for k in nodes:
            if k == ZERO:
                self.pairs = {(a, b): w for (a, b), w in self.far.items() if ZERO not in (a, b)}
            for i in nodes:
                for j in nodes:
                    if (i, k) in self.far and (k, j) in self.far:
                        self.at_least(i, self.far[i, k] + self.far[k, j], j)
        loop = next((n for n in nodes if self.far.get((n, n), 0) > 0), None)
        if loop is not None:
            raise Contradiction(f"conditions on {', '.join(self.names)} contradict each other")
        return self

    def bound(self, name: str) -> tuple[Fraction | None, Fraction | None]:
        high = self.far.get((name, ZERO))
        return self.far.get((ZERO, name)), None if high is None else -high

    def tied(self, a: str, b: str) -> bool:
        return (a, b) in self.pairs and (b, a) in self.pairs and self.pairs[a, b] + self.pairs[b, a] == 0

    def in_order(self) -> list[str]:
        """Names with lower ones first; ties in the given order."""
        below = {n: sum((m, n) in self.pairs and not self.tied(m, n) for m in self.names if m != n) for n in self.names}
        return sorted(self.names, key=lambda n: below[n])


def systems(atoms: Iterable, dtype_of: Callable[[str], T.DataType | None]) -> list[tuple[System, list]]:
    """The closed systems of a list of atoms, with the atoms each covers.

    Columns joined by comparisons are one system. A lone comparison of two numbers, or of a number with a literal, needs
    none; times always do, and so do chains.
    """
    edges, group = [], {}

    def find(n: str) -> str:
        while group.setdefault(n, n) != n:
            n = group[n]
        return n

    for a in atoms:
        kind = dtype_of(a.left)
        if kind is None or not (is_time(kind) or isinstance(kind, V.NUMERIC)) or a.op not in (*LOWER, *UPPER, ast.Eq):
            continue
        if a.is_column:
            other = dtype_of(str(a.right))
            if other is None or is_time(other) != is_time(kind) or not (is_time(other) or isinstance(other, V.NUMERIC)):
                continue
            group[find(a.left)] = find(str(a.right))
        elif amount(a.right, kind) is None:
            continue
        else:
            find(a.left)
        edges.append(a)
    out = []
    for root in dict.fromkeys(find(n) for n in list(group)):
        mine = [a for a in edges if find(a.left) == root]
        names = list(dict.fromkeys(n for a in mine for n in ([a.left, str(a.right)] if a.is_column else [a.left])))
        timed, pairs = is_time(dtype_of(names[0])), sum(a.is_column for a in mine)
        ordered = any(a.op is not ast.Eq for a in mine)
        if not ordered or not (timed or pairs > 1 or (pairs and len(mine) > pairs)):
            continue
        system = System(names)
        for a in mine:
            kind = dtype_of(a.left)
            if a.is_column:
                b, gap = str(a.right), min(step(kind), step(dtype_of(str(a.right))))
                low, high = (a.left, b) if a.op in LOWER or a.op is ast.Eq else (b, a.left)
                strict = LOWER.get(a.op, False) or UPPER.get(a.op, False)
                system.at_least(low, gap if strict else Fraction(0), high)
                if a.op is ast.Eq:
                    system.at_least(high, Fraction(0), low)
            else:
                c, gap = amount(a.right, kind), step(kind, a.right)
                if a.op in LOWER or a.op is ast.Eq:
                    system.at_least(a.left, -(c - (gap if LOWER.get(a.op) else 0)), ZERO)
                if a.op in UPPER or a.op is ast.Eq:
                    system.at_least(ZERO, c + (gap if UPPER.get(a.op) else 0), a.left)
        out.append((system.close(), mine))
    return out


def _moved(c: Column, w: Fraction, timed: bool) -> Column:
    if w == 0:
        return c
    if timed:
        return F.timestamp_add("MICROSECOND", F.lit(int(w * 1_000_000)), c)
    return c + F.lit(float(w))


def _whole(c: Column, dtype: T.DataType, up: bool) -> Column:
    """Rounded to what the type can hold: whole numbers, whole days."""
    if isinstance(dtype, V.INTEGRAL):
        return (F.ceil(c) if up else F.floor(c)).cast("double")
    if isinstance(dtype, T.DateType):
        day = F.date_trunc("DAY", c).cast("timestamp_ntz")
        return F.when(day < c, F.timestamp_add("DAY", F.lit(1), day)).otherwise(day) if up else day
    return c


def _constant(w: Fraction, timed: bool) -> Column:
    return F.lit(EPOCH + dt.timedelta(microseconds=int(w * 1_000_000))).cast("timestamp_ntz") if timed else F.lit(float(w))


def solution(system: System, current: Callable[[str], Column], dtype_of: Callable[[str], T.DataType], start: dt.datetime) -> dict[str, Column]:
    """An expression for each column: its value where the conditions hold, else the nearest one upwards (or its bound)."""
    timed = is_time(dtype_of(system.names[0]))
    kind = "timestamp_ntz" if timed else "double"
    now = {n: current(n).cast(kind) for n in system.names}
    rest = _constant(Fraction((start - EPOCH) // dt.timedelta(microseconds=1), 1_000_000) if timed else Fraction(0), timed)
    out: dict[str, Column] = {}
    for n in system.in_order():
        twin = next((m for m in out if system.tied(m, n)), None)
        if twin is not None:
            out[n] = _moved(out[twin], system.pairs[twin, n], timed)
            continue
        low, high = system.bound(n)
        value = F.coalesce(now[n], *[now[m] for m in system.names if m != n], rest)
        if high is not None:
            value = F.least(value, _whole(_constant(high, timed), dtype_of(n), False))
        floors = [_moved(c, system.pairs[m, n], timed) for m, c in out.items() if (m, n) in system.pairs]
        floors += [_constant(low, timed)] if low is not None else []
        out[n] = _whole(F.greatest(value, *floors) if floors else value, dtype_of(n), True)
    return out
