"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

MODULES = ("pages", "pairs", "groups", "overlap", "consensus", "packing", "mixing", "sentences")


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle_sql() -> dict:
    found = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{name}"), "SQL", {})
    return found
