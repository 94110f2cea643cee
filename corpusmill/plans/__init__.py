"""The query catalogue: each entry has a DataFrame form, and SQL where SQL can express it."""

from __future__ import annotations

import importlib

#: Modules of this package; each has QUERIES (name -> function of spark and sf_dir) and SQL (name -> text).
CATALOGUE: tuple[str, ...] = ("indexes", "sessions", "stores", "exams", "retrieval", "corpus", "study", "evaluation", "bank", "memory", "places", "planner", "candidates", "dialogue", "statutes")


def _all(attribute: str) -> dict:
    found: dict = {}
    for name in CATALOGUE:
        found |= getattr(importlib.import_module(f"{__name__}.{name}"), attribute)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
