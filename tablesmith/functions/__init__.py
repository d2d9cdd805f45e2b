"""Column builders: draws, generators, predicates, formulas."""
