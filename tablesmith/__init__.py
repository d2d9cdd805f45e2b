"""tablesmith: seeded table synthesis, edge-case planting and record repair on Spark."""

from tablesmith.spec import ColumnSpec, EdgeCase, EventSpec, Spec

__all__ = ["ColumnSpec", "EdgeCase", "EventSpec", "Spec"]
