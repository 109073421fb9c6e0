"""Every query of the library by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules of this package that register queries.
FAMILIES: tuple[str, ...] = ("checks", "timeline", "matching", "quotes", "rules", "people", "alternatives", "passages", "fields", "lookups", "statements", "evidence", "excerpts", "audit", "paragraphs", "stated", "cited")


def _gather(what: str) -> dict:
    found: dict = {}
    for family in FAMILIES:
        part = getattr(import_module(f"veriframe.plans.{family}"), what)
        if clash := found.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        found |= part
    return found


def queries() -> dict[str, Callable]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
