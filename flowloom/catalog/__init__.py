"""Registered queries."""

import importlib

from flowloom.catalog.registry import ORACLES, QUERIES

AREAS = ["expressions", "graphs", "splitting", "evaluation", "operations", "models", "feeds"]


def load():
    for area in AREAS:
        importlib.import_module(f"flowloom.catalog.{area}")
    return QUERIES, ORACLES
