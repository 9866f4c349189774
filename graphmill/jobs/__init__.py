"""Registered queries, one module for each section of the operator inventory."""

from __future__ import annotations

import importlib

MODULES: list[str] = ["corpus", "logs", "parsing", "features", "relate", "hilbert", "conjectures", "order", "models", "graph_models", "streams"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
