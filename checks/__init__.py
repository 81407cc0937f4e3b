"""Queries over the test tables, and the SQL they must agree with."""

from importlib import import_module

PARTS = ("plans", "profiles", "cleaning", "dashboards", "forecasts", "sources")


def load():
    """Import every part once and return the filled registry."""
    for part in PARTS:
        import_module(f"checks.{part}")
    return import_module("checks.registry")
