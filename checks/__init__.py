"""Registered queries, one or more per operator, each with the SQL it must agree with."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("pixels", "scalars", "grids", "analyses", "lake_io")


def load_registry():
    from checks.base import REGISTRY

    for module in _MODULES:
        import_module(f"checks.{module}")
    return REGISTRY
