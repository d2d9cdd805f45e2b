"""Registered queries with their SQL equivalents."""

from importlib import import_module

SECTIONS = ["generators", "suppression", "composition", "predicates", "edges", "repairs", "tables", "jobs"]


def all_queries():
    """Import every section and return (queries, oracles)."""
    from checks import registry

    for section in SECTIONS:
        import_module(f"checks.{section}")
    return registry.QUERIES, registry.ORACLES
