"""``@query(sql)`` registers a plan under its function's name, with the oracle SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    def register(plan: Callable) -> Callable:
        if plan.__name__ in QUERIES:
            raise ValueError(f"query {plan.__name__} is registered twice")
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLES[plan.__name__] = sql.strip()
        return plan

    return register
