"""How queries are registered: a name, a Spark plan, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from waymark.plans import fixtures
from waymark.session import prepare

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a plan; ``$name`` in the SQL stands for a fixture's SQL."""

    def register(plan: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(plan)
        def run(spark, sf_dir):
            return plan(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = fixtures.expand(sql)
        return plan

    return register
