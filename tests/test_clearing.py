"""Fewest changes against exhaustive search, and systems of comparisons against brute force."""

import datetime as dt
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.operators import edgecases as E
from tablesmith.operators import systems
from tablesmith.operators.clearing import clear_cases, smallest_sets
from tablesmith.operators.synthesize import Settings
from tablesmith.spec import ColumnSpec, EdgeCase, Spec

DOMAIN = range(0, 6)
FIELDS = "abcde"
SETTINGS = Settings(seed=3, as_of=dt.datetime(2024, 6, 1))


def columns(names=FIELDS, high=5):
    return tuple(ColumnSpec(n, "int", "int_range", {"min": 0, "max": high}) for n in names)


CASES = [
    ("a >= 3 and b >= 3", "b >= 2 and c <= 2", "c == 1 and d != 4"),
    ("a in [1, 2, 3] and b not in [0, 5]", "a == 2 or d == 2 and e > 0", "e >= 4 and d <= 1"),
    ("a > 1 and b > 1 and c > 1", "c > 2 and d > 2 and e > 2", "a > 3 or e == 0"),
    ("a < b and c > 0", "b > 4", "not (d < 2 or e < 2)"),
]


def meets(row, conditions):
    return any(eval(c, {}, row) for c in conditions)  # the test's own conditions are Python


@pytest.mark.parametrize("conditions", CASES)
def test_fewest_fields_are_changed(spark, conditions):
    rng = random.Random(1)
    rows = [tuple(rng.choice(DOMAIN) for _ in FIELDS) for _ in range(150)]
    spec = Spec(columns(), edge_cases=tuple(EdgeCase(f"case {k}", c) for k, c in enumerate(conditions)))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, " + ", ".join(f"{n} long" for n in FIELDS))
    fixed = {r.id: tuple(r[n] for n in FIELDS) for r in clear_cases(df, spec, None).collect()}
    for k, row in enumerate(rows):
        new, need = fixed[k], 0
        assert not meets(dict(zip(FIELDS, new)), conditions)
        if meets(dict(zip(FIELDS, row)), conditions):
            wider = range(-2, 9)
            need = next(n for n in range(1, 6) if any(
                not meets(dict(zip(FIELDS, [v if i in at else x for i, x in enumerate(row) for v in [dict(zip(at, vs)).get(i)]])), conditions)
                for at in itertools.combinations(range(5), n) for vs in itertools.product(wider, repeat=n)))
        assert sum(x != y for x, y in zip(row, new)) == need, (row, new)


def test_smallest_sets_against_all_subsets():
    rng = random.Random(2)
    order = list("abcdefg")
    for _ in range(20):
        groups = [frozenset(rng.sample(order, rng.randrange(1, 5))) for _ in range(6)]
        for met, chosen in enumerate(smallest_sets(groups, order)):
            hit = {order[k] for k in range(7) if chosen >> k & 1}
            wanted = [g for k, g in enumerate(groups) if met >> k & 1]
            assert all(g & hit for g in wanted)
            assert len(hit) == next(n for n in range(8) if any(all(g & set(s) for g in wanted) for s in itertools.combinations(order, n)))


def test_more_groups_than_a_table_holds(spark):
    names = [f"n{k}" for k in range(14)]
    spec = Spec(columns(names, 9), edge_cases=tuple(EdgeCase(a, f"{a} >= 5 and {b} >= 5") for a, b in zip(names, names[1:])))
    df = spark.range(3000).select("id", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10)).alias(n) for k, n in enumerate(names)])
    fixed = clear_cases(df, spec, None)
    assert fixed.filter(" OR ".join(f"({a} >= 5 AND {b} >= 5)" for a, b in zip(names, names[1:]))).count() == 0


def test_twelve_fields_take_seconds(spark):
    names = [f"n{k}" for k in range(12)]
    cases = [names[:5], names[4:8], names[7:]]
    spec = Spec(columns(names, 9), edge_cases=tuple(EdgeCase(c[0], " and ".join(f"{n} >= 2" for n in c)) for c in cases))
    df = spark.range(0, 100_000, 1, 8).select("id", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10)).alias(n) for k, n in enumerate(names)])
    began = time.time()
    met = " OR ".join("(" + " AND ".join(f"{n} >= 2" for n in c) + ")" for c in cases)
    assert clear_cases(df, spec, None).filter(met).count() == 0
    assert time.time() - began < 60


def test_fields_behind_formulas_and_labels_and_times(spark):
    spec = Spec((ColumnSpec("x", "float", "uniform", {"min": 0, "max": 10}), ColumnSpec("t", "datetime"), ColumnSpec("twice", "float", "formula", formula="x * 2")),
                edge_cases=(EdgeCase("large", "twice > 10"), EdgeCase("late", "t >= '2024-01-01'")))
    day = dt.datetime(2024, 1, 5)
    df = spark.createDataFrame([(1, 9.0, day, 18.0, False), (2, 9.0, day, 18.0, True), (3, 1.0, None, 2.0, None)], "id long, x double, t timestamp_ntz, twice double, is_edge_case boolean")
    got = {r.id: (r.x, r.t, r.twice) for r in clear_cases(df, spec).collect()}
    assert got[2] == (9.0, day, 18.0) and got[3] == (1.0, None, 2.0)
    assert got[1][1] == dt.datetime(2023, 12, 31, 23, 59, 59) and got[1][2] == got[1][0] * 2 <= 10
    with pytest.raises(Exception, match="clear of the edge cases"):
        clear_cases(df, Spec(spec.columns[:1], edge_cases=(EdgeCase("any", "x > -100 or x <= -100"),)), None).collect()


# -- systems --


def kinds(name):
    return {"i": T.LongType(), "j": T.IntegerType(), "x": T.DoubleType(), "t": T.TimestampNTZType(), "u": T.TimestampNTZType(), "d": T.DateType()}.get(name)


@pytest.mark.parametrize("text", ["t > u and u >= t", "i < j and j < i", "t < u and u < d and d < t", "t > '2030-01-01' and t < '2020-01-01'", "i <= j and j <= 3 and i > 3", "x < i and i < j and j < x"])
def test_contradictions_come_before_any_job(spark, text):
    [atoms] = E.branches(text)
    with pytest.raises(systems.Contradiction):
        systems.systems(atoms, kinds)
    dtypes = {"i": "int", "j": "int", "x": "float", "t": "datetime", "u": "datetime", "d": "date"}
    spec = Spec(tuple(ColumnSpec(n, k) for n, k in dtypes.items()), edge_cases=(EdgeCase("never", text),), edge_fraction=0.5)
    with pytest.raises(ValueError, match="contradicts itself"):
        E.place_cases(spark.range(3), "id", spec)


def test_random_systems_hold(spark):
    rng = random.Random(7)
    fields = {"i": "int", "j": "int", "x": "float", "y": "float", "z": "float"}
    spec = Spec(tuple(ColumnSpec(n, k) for n, k in fields.items()))
    cases = []
    while len(cases) < 12:
        atoms = [f"{a} {rng.choice(['<', '<=', '>', '>='])} {b}" for a, b in (rng.sample(list(fields), 2) for _ in range(3))]
        atoms += [f"{rng.choice(list(fields))} {rng.choice(['<', '>=', '<=', '>'])} {rng.randrange(-9, 9)}" for _ in range(rng.randrange(3))]
        case = EdgeCase(f"case {len(cases)}", " and ".join(atoms))
        if all(E.feasible(b, spec) for b in E.branches(case.condition)):
            cases.append(case)
    rows = [(k, case.name, *[rng.choice([None, rng.randrange(-20, 20)]) for _ in "ij"], *[rng.choice([None, round(rng.uniform(-20, 20), 2)]) for _ in "xyz"]) for k in range(15) for case in cases]
    df = spark.createDataFrame(rows, "id long, edge_case_name string, i long, j long, x double, y double, z double")
    made = E.apply_cases(df, Spec(spec.columns, edge_cases=tuple(cases)), SETTINGS, "id", strict=False)
    text = {c.name: c.condition for c in cases}
    for row in made.collect():
        assert row.is_edge_case and eval(text[row.edge_case_name], {}, row.asDict()), (row, text[row.edge_case_name])


def test_rows_that_hold_keep_their_values(spark):
    case = EdgeCase("chain", "t < u and u < d and x >= 1 and x <= y")
    spec = Spec((ColumnSpec("t", "datetime"), ColumnSpec("u", "datetime"), ColumnSpec("d", "date"), ColumnSpec("x", "float"), ColumnSpec("y", "float")), edge_cases=(case,))
    t = dt.datetime(2024, 1, 1, 12)
    held = (t, t + dt.timedelta(seconds=5), dt.date(2024, 1, 2), 1.5, 2.0)
    broken = (t, None, dt.date(2023, 1, 1), None, None)
    df = spark.createDataFrame([(1, "chain", *held), (2, "chain", *broken)], "id long, edge_case_name string, t timestamp_ntz, u timestamp_ntz, d date, x double, y double")
    got = {r.id: (r.t, r.u, r.d, r.x, r.y) for r in E.apply_cases(df, spec, SETTINGS, "id").collect()}
    assert got[1] == held
    assert got[2] == (t, t + dt.timedelta(seconds=1), dt.date(2024, 1, 2), 1.0, 1.0)
