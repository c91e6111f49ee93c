"""All registered queries: name -> callable, and name -> SQL that gives the same rows."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


for _part in ("logs", "audit", "quality", "basics", "gold"):
    importlib.import_module(f"granary.plans.{_part}")
