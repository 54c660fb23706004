"""Every query over the shared tables, with its SQL counterpart.

A query's name starts with the inventory id that it applies.
"""

from __future__ import annotations

from importlib import import_module

from tidemark.plans.register import ORACLE_SQL, QUERIES  # noqa: F401

for _part in ("market", "windows", "joined", "cross_section", "outcomes", "tables", "features", "bar_features", "formulas", "streams", "further", "additional", "reports", "structure", "rolling", "clocks", "voids", "scenes", "divergence"):
    import_module(f"tidemark.plans.{_part}")

FLAGSHIP = "pf03_daily_books"
