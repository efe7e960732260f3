"""The registry of queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from functools import cache

@cache
def _gathered() -> tuple[dict, dict]:
    """Every module beside this one registers its queries with ``registry`` when it is imported."""
    from tessera import plans
    from tessera.plans import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        importlib.import_module(f"tessera.plans.{module}")
    return registry.QUERIES, registry.ORACLES


def queries() -> dict[str, Callable]:
    return dict(_gathered()[0])


def oracle_sql() -> dict[str, str]:
    return dict(_gathered()[1])
