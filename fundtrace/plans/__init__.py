"""Registered queries over the given tables, one module for each family of operators."""

from __future__ import annotations

import importlib

FAMILIES = ("timeseries", "joins", "scores", "levels", "evaluation", "models", "actions", "selection", "training", "filters")


def _registry():
    for name in FAMILIES:
        importlib.import_module(f"fundtrace.plans.{name}")
    from fundtrace.plans import registry

    return registry


def queries():
    return dict(_registry().QUERIES)


def oracle_sql():
    return dict(_registry().SQL)
