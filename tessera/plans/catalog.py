"""Registry of the core queries and their SQL."""

from __future__ import annotations

import importlib

from tessera.plans import registry

MODULES = ("retrieval", "knowledge", "pipeline", "sources", "extras", "evidence_plans")

for _name in MODULES:
    importlib.import_module(f"tessera.plans.{_name}")


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
