"""Queries by operator id: ``queries()`` and ``oracles()`` import them all."""

from __future__ import annotations

import importlib

MODULES = ("cells", "samples", "scalars", "summaries", "spatial", "measurements", "scoring", "distributions", "randomfields", "conditioning", "sequences", "studies", "steps", "compatibility")


def _all():
    for name in MODULES:
        importlib.import_module(f"gridweave.plans.{name}")
    return importlib.import_module("gridweave.plans.registry")


def queries():
    return dict(_all().QUERIES)


def oracles():
    return dict(_all().ORACLES)
