"""Registered queries: the operators applied to the given tables."""

from __future__ import annotations

import importlib

MODULES = ["community", "evidence", "retrieval", "review", "quality", "streams", "files"]


def load_all():
    from quillspark.plans.registry import REGISTRY

    for module in MODULES:
        importlib.import_module(f"quillspark.plans.{module}")
    return REGISTRY
