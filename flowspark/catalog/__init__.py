"""Operator calls on the bound test tables, with their SQL twins."""

import importlib

from flowspark.catalog.registry import ENTRIES, run

MODULES = ("stats", "weather_energy", "toolkit", "model", "network", "events_plans", "records", "deliveries", "views", "learning", "multimodal")


def load() -> dict:
    for m in MODULES:
        importlib.import_module(f"flowspark.catalog.{m}")
    return ENTRIES
