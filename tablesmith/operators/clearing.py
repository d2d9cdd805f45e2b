"""Change the fewest fields of rows that meet an edge case, so that they meet none.

A case is a list of alternatives, each a list of comparisons that hold together; alternatives on the same fields form a
group. A field's *neutral* value is the nearest one at which none of its comparisons holds, so putting it there breaks
every group with that field and makes no other group true. For every set of groups that a row can meet, the driver finds
the smallest set of fields that touches them all; a row looks its set up by the groups it meets.

Where one field is enough, its declared alternatives are tried first (other choices, a step down or up, bounds). Fields
that only act through formulas have no neutral value; rows that the lookup leaves unclear get one pass over the
fields, each put to the value that leaves the fewest groups. The work grows with the number of comparisons.
"""

from __future__ import annotations

import ast
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions import expressions as X
from tablesmith.functions import values as V
from tablesmith.operators import edgecases as E
from tablesmith.operators import systems
from tablesmith.spec import ColumnSpec, Spec, names_in

TABLED_GROUPS = 12


class Group:
    """Alternatives of one event on the same fields."""

    def __init__(self, fields: frozenset[str], event: str | None):
        self.fields, self.event, self.branches = fields, event, []

    def holds(self, lookup: X.Lookup, event: Column | None) -> Column:
        found = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [X.matches(a.node(), lookup) for a in atoms], F.lit(True)) for atoms in self.branches])
        if self.event and event is not None:
            return found & F.coalesce(F.upper(F.translate(F.trim(event), " ", "_")) == self.event, F.lit(False))
        return found


def levers(name: str, spec: Spec) -> set[str]:
    """The fields to change where a condition names a field: itself, or the inputs of its formula."""
    if name not in spec.formulas:
        return {name}
    return {m for n in names_in(spec.formulas[name]) if n != name for m in levers(n, spec)}


def groups_of(spec: Spec, known) -> list[Group]:
    found: dict[tuple, Group] = {}
    for case in spec.edge_cases:
        event = case.event_type.strip().upper().replace(" ", "_") if case.event_type else None
        for atoms in E.branches(case.condition or ""):
            named = {n for a in atoms for n in ([a.left, str(a.right)] if a.is_column else [a.left])}
            if any(known(n) is None for n in named):
                continue  # a condition on a missing field never holds
            fields = frozenset(m for n in named for m in levers(n, spec) if known(m) is not None)
            found.setdefault((fields, event), Group(fields, event)).branches.append(atoms)
    return list(found.values())


def smallest_sets(groups: list[frozenset[str]], order: list[str]) -> list[int]:
    """For every set of groups (as bits): the smallest set of fields (as bits of ``order``) that touches each; first fields first."""
    hits = {f: sum(1 << g for g, fields in enumerate(groups) if f in fields) for f in order}

    @cache
    def best(met: int) -> tuple[int, int]:
        if not met:
            return 0, 0
        first = groups[(met & -met).bit_length() - 1]
        options = []
        for k, f in enumerate(order):
            if f in first:
                size, chosen = best(met & ~hits[f])
                options.append((size + 1, chosen | 1 << k))
        return min(options, default=(0, 0))

    return [best(met)[1] for met in range(1 << len(groups))]


def other_side(atom, name: str, dtype: T.DataType, lookup: X.Lookup) -> list[Column]:
    """Values of a field next to the border of a comparison."""
    if atom.is_column:
        other = lookup(str(atom.right) if atom.left == name else atom.left)
        if other is None or not isinstance(dtype, (*V.NUMERIC, *V.TEMPORAL)):
            return []
        gap = systems.step(dtype)
        return [other[0].cast(dtype), *[_shifted(other[0], dtype, w) for w in (-gap, gap)]]
    listed = list(atom.right) if isinstance(atom.right, (list, tuple)) else [atom.right]
    if atom.op in (ast.NotEq, ast.NotIn):
        return [F.lit(v).cast(dtype) for v in listed if v is not None]
    near = systems.amount(listed[0], dtype)
    if near is None:
        return []
    at, gap = systems._constant(near, systems.is_time(dtype)), systems.step(dtype)
    moves = {ast.Gt: (0,), ast.Lt: (0,), ast.GtE: (-gap,), ast.LtE: (gap,)}.get(atom.op, (-gap, gap))
    return [_shifted(at, dtype, w) for w in moves]


def _shifted(c: Column, dtype: T.DataType, w) -> Column:
    return systems._moved(c.cast("timestamp_ntz") if systems.is_time(dtype) else c.cast("double"), w, systems.is_time(dtype)).cast(dtype)


def _different(atoms) -> list:
    return list({a.node(): a for a in atoms}.values())


def distance(a: Column, b: Column, dtype: T.DataType) -> Column:
    """How far a new value is from the old one; values without a distance keep their order."""
    if isinstance(dtype, V.NUMERIC):
        return F.abs(a.cast("double") - b.cast("double"))
    if isinstance(dtype, V.TEMPORAL):
        return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))).cast("double")
    return F.lit(0.0)


def clear_cases(df: DataFrame, spec: Spec, label: str | None = "is_edge_case", among: Column | None = None) -> DataFrame:
    """Unlabelled rows (of ``among``) that meet a case, changed in the fewest fields so that they meet none.

    Formulas follow their inputs. A row for which no value is found fails the job.
    """
    event = F.col("event_type") if "event_type" in df.columns else None
    lookup = X.fields_of(df)
    groups = groups_of(spec, lookup)
    used = {f for g in groups for f in g.fields}
    named = list(dict.fromkeys(m for c in spec.edge_cases for n in E._ordered_names(c.condition or "") for m in sorted(levers(n, spec))))
    names = [n for n in named if n in used]
    if not names:
        return df
    kinds = {n: lookup(n)[1] for n in names}
    kind = T.StructType([T.StructField(n, kinds[n]) for n in names])
    formulas = {n: f for n, f in spec.formulas.items() if lookup(n) is not None}
    atoms = {n: _different(a for g in groups for b in g.branches for a in b if n in (a.left, str(a.right) if a.is_column else a.left)) for n in names}

    def record(values: dict[str, Column]) -> Column:
        return F.struct(*[values[n].cast(kinds[n]).alias(n) for n in names]).cast(kind)

    def around(r: Column | None, changed: dict[str, Column] | None = None) -> X.Lookup:
        def plain(n: str) -> X.Field | None:
            if changed is not None and n in changed:
                return changed[n], kinds[n]
            return (r[n], kinds[n]) if r is not None and n in kinds else lookup(n)

        return X.with_formulas(plain, formulas)

    def clear(r: Column) -> Column:
        return ~X.matches_any(spec.edge_cases, around(r), event)

    def candidates(n: str, near: X.Lookup) -> Column:
        """Declared alternatives, then values at the borders of the field's comparisons that lie in its declared bounds."""
        borders = [v for a in atoms[n] for v in other_side(a, n, kinds[n], near)]
        declared = E._alternatives(n, spec, near)
        params = spec.column(n).params if n in spec and isinstance(kinds[n], V.NUMERIC) else {}
        low, high = (X._literal_number(params.get(x)) for x in ("min", "max"))

        def allowed(v: Column) -> Column:
            return v.isNotNull() & (F.lit(True) if low is None else v >= low) & (F.lit(True) if high is None else v <= high)

        return F.concat(declared, F.filter(F.array(*borders), allowed)) if borders else declared

    def neutral(n: str) -> Column:
        """The nearest candidate at which no comparison of the field holds; null if there is none."""
        def quiet(v: Column) -> Column:
            here = around(None, {n: v})
            return ~reduce(lambda a, b: a | b, [X.matches(a.node(), here) for a in atoms[n]], F.lit(False))

        ranked = F.transform(F.filter(candidates(n, lookup), quiet), lambda v, k: F.struct(distance(v, lookup(n)[0], kinds[n]).alias("d"), k.alias("k"), v.alias("v")))
        return F.array_min(ranked)["v"]

    hit = X.matches_any(spec.edge_cases, lookup, event)
    if among is not None:
        hit = among & hit
    if label is not None and label in df.columns:
        hit = hit & ~F.coalesce(F.col(label), F.lit(False))

    tabled = len(groups) <= TABLED_GROUPS
    bit = {n: 1 << k for k, n in enumerate(names)}
    met = [g.holds(around(None), event) for g in groups]
    if tabled:
        number = reduce(lambda a, b: a + b, [F.when(m, 1 << k).otherwise(0) for k, m in enumerate(met)])
        table = smallest_sets([g.fields for g in groups], names)
        mask = F.get(F.lit(table) if len(table) > 1 else F.array(F.lit(table[0])), number)
    else:  # too many sets to list: group by group, the field that is in most groups
        cover = {n: sum(n in g.fields for g in groups) for n in names}
        own = F.lit([sum(bit[n] for n in g.fields) for g in groups])
        best = F.lit([bit[max(sorted(g.fields, key=names.index), key=cover.get)] for g in groups])
        met = F.array(*met)
        mask = F.aggregate(F.sequence(F.lit(0), F.lit(len(groups) - 1)), F.lit(0), lambda done, k: F.when(
            F.get(met, k) & (done.bitwiseAND(F.get(own, k)) == 0), done.bitwiseOR(F.get(best, k))).otherwise(done))

    current = {n: F.col(n) for n in names}

    whole = record(current)

    def alone_in(n: str, r: Column, near: X.Lookup) -> Column:
        return F.transform(candidates(n, near), lambda v: r.withField(n, v))

    singles = F.concat(*[alone_in(n, whole, lookup) for n in names])
    single = F.try_element_at(F.filter(singles, clear), F.lit(1))
    chosen = record({n: F.when(F.col("__mask").bitwiseAND(bit[n]) != 0, F.coalesce(neutral(n), F.col(n))).otherwise(F.col(n)) for n in names})

    def scored(r: Column, k: Column) -> Column:
        return F.struct(reduce(lambda a, b: a + b, [g.holds(around(r), event).cast("int") for g in groups]).alias("met"), k.alias("k"), r.alias("r"))

    def one_pass() -> Column:
        def turn(r: Column, k: Column) -> Column:
            others = V.first_match([(k == i, alone_in(n, r, around(r))) for i, n in enumerate(names)])
            return F.array_min(F.transform(F.concat(F.array(r), others), scored))["r"]

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(names) - 1)), whole, turn)

    def if_clear(r: Column) -> Column:
        return F.try_element_at(F.filter(F.array(r), clear), F.lit(1))

    failed = F.raise_error(F.lit("no declared value keeps a normal row clear of the edge cases")).cast(kind)
    # One field can only be enough where the smallest set has one field.
    alone = F.when(F.bit_count("__mask") <= 1, single) if tabled else single
    staged = df.withColumn("__mask", F.when(hit, mask))
    helped = F.when(F.col("__mask").isNotNull(), F.coalesce(alone, if_clear(chosen), if_clear(one_pass()), failed))
    # One row from one row: a filter or a later column must not repeat the search in the plan.
    staged = staged.withColumn("__clear", F.explode(F.array(helped)))
    fixed = F.col("__clear").isNotNull()
    after = around(F.col("__clear"))
    moved = [n for n in spec.formulas if lookup(n) is not None and E._reaches(spec, n, set(names))]
    return staged.select(*[F.when(fixed, after(n)[0]).otherwise(F.col(n)).alias(n) if n in names or n in moved else F.col(n) for n in df.columns])
