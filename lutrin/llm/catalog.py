"""Queries and SQL of the subpackage, for the driver's entry file."""

from __future__ import annotations

import importlib

MODULES = ("scans", "consensus", "keyness", "lookalike", "neardup", "splitting", "packing", "mixing", "personal")


def _modules():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.strip() for m in _modules() for k, q in m.ORACLE.items()}
