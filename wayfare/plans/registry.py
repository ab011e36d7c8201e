"""All queries by name, and their SQL twins."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


for _part in ("cleaning", "features", "retrieval", "quality", "streams", "extras", "more"):
    importlib.import_module(f"wayfare.plans.{_part}")
