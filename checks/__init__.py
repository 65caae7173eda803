"""Registered queries over the test tables and the SQL they are compared with."""

from __future__ import annotations

import importlib

MODULES = ("matrices_and_candidates", "features", "primitives", "learning")


def load_all():
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"checks.{name}")
    return importlib.import_module("checks.registry")
