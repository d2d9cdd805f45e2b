import pytest

from tablesmith.spec import (ColumnSpec, EventSpec, Spec, declared_constraints, formula_table, names_in, resolve_entity_key,
                             with_rule_formulas)

A, B = ColumnSpec("a", "float"), ColumnSpec("b", "float", "formula", formula="a * 2")
C = ColumnSpec("c", "datetime", "ts_offset", {"base_field": "t"})
T = ColumnSpec("t", "datetime", "recent_datetime", {"days_back": 1})


def test_closure_follows_formulas_and_parameters_in_catalog_order():
    spec = Spec((C, B, A, T))
    assert spec.closure(["c"]) == ["c", "t"]
    assert spec.closure(["b", "c"]) == ["c", "b", "a", "t"]


def test_levels_put_inputs_first_and_reject_cycles():
    spec = Spec((C, B, A, T))
    assert spec.levels(spec.names) == [["a", "t"], ["c", "b"]]
    loop = Spec((ColumnSpec("x", "float", "formula", formula="y + 1"), ColumnSpec("y", "float", "formula", formula="x")))
    with pytest.raises(ValueError, match="circular"):
        loop.levels(loop.names)


def test_entity_fields_exclude_event_columns_but_keep_the_key():
    spec = Spec((A, B, C, T), events=(EventSpec("E", 1, ("b", "a", "c")),), entity_key="a")
    assert spec.entity_fields() == ["a", "t"]
    assert spec.event_fields("E") == ["b", "a", "c"]


def test_event_occurrences_are_clamped():
    assert (EventSpec("E", 1, (), -3, 5000).clamped().min_occurrences, EventSpec("E", 1, (), -3, 5000).clamped().max_occurrences) == (1, 5000)
    assert EventSpec("E", 1, (), 7, 2).clamped().max_occurrences == 7


def test_duplicate_columns_and_unknown_entity_key_are_errors():
    with pytest.raises(ValueError, match="twice"):
        Spec((A, A))
    with pytest.raises(ValueError, match="entity key"):
        Spec((A,), entity_key="z")


def test_rule_formulas_replace_generators_but_not_formulas():
    spec = with_rule_formulas(Spec((A, B)), {"a": "1 + 1", "b": "9"})
    assert spec.formulas == {"a": "1 + 1", "b": "a * 2"}
    assert formula_table(Spec((A, B)), {"b": "9", "z": "a"}) == {"b": "a * 2", "z": "a"}


def test_declared_constraints_yield_to_explicit_ones():
    spec = Spec((ColumnSpec("n", "int", "int_range", {"min": 1, "max": 9}), ColumnSpec("w", "categorical", "weighted_choice", {"choices": ["x"]})))
    assert declared_constraints(spec, {"n": {"max": 5}}) == {"n": {"min": 1, "max": 5}, "w": {"valid_values": ["x"]}}


def test_entity_key_resolution():
    assert resolve_entity_key("b", ["a", "b"], "a") == "b"
    assert resolve_entity_key("nope", ["x", "customer_id"], "customer_id") == "customer_id"
    assert resolve_entity_key(None, ["x", "y"], "customer_id") == "x"


def test_names_in_skip_functions():
    assert names_in("round(min(a, b), 2)") == {"a", "b"}
