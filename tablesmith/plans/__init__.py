"""Preset specs and end-to-end jobs built from the operators."""
