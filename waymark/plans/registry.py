"""All registered queries and their SQL twins, by name."""

from __future__ import annotations

import importlib
import pkgutil

from waymark import plans
from waymark.plans.define import ORACLES, QUERIES

for _module in pkgutil.iter_modules(plans.__path__):
    if _module.name.startswith("q_"):
        importlib.import_module(f"waymark.plans.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
