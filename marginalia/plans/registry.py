"""All queries of the core, with the SQL that checks them where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["graph", "entries", "timestamps"]


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"{__package__}.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
