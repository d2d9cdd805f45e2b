"""Operators for preparing training text: one module each, their queries in ``queries``."""
