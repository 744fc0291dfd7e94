"""Registered queries, by topic."""

from importlib import import_module

from stepgrid.catalog.base import ORACLES, QUERIES

MODULE_OF: dict[str, str] = {}
TOPICS = ("windows", "cleaning", "transforms", "calendar", "scoring", "clinical", "rollups", "forecasting", "sampling", "inputs")

for _topic in TOPICS:
    _known = set(QUERIES)
    import_module(f"stepgrid.catalog.{_topic}")
    MODULE_OF.update({n: _topic for n in QUERIES if n not in _known})

__all__ = ["MODULE_OF", "ORACLES", "QUERIES"]
