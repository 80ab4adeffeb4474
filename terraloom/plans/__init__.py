"""Query definitions, one module per topic."""

from __future__ import annotations

import importlib
from types import ModuleType

TOPICS: tuple[str, ...] = ("metrics", "sampling", "temporal", "raster", "parcels", "models", "ingest")


def load() -> ModuleType:
    """Import every topic once and return the filled registry."""
    for topic in TOPICS:
        importlib.import_module(f"terraloom.plans.{topic}")
    return importlib.import_module("terraloom.plans.registry")
