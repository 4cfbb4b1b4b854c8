"""All queries of the library by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

for _plan in ("search", "understanding", "quality", "ledger", "trust", "graph", "dedup", "extraction", "passages", "peers", "evaluation", "crawl", "streams", "requests", "maintenance", "web", "results", "network", "api", "files"):
    import_module(f".plans.{_plan}", __package__)

__all__ = ["ORACLES", "QUERIES"]
