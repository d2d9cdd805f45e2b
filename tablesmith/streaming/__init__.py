"""Structured Streaming forms of the record repairs."""
