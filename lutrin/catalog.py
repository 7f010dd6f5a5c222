"""Queries and SQL of the core, for the driver's entry file."""

from __future__ import annotations

from lutrin.operators import ledger
from lutrin.plans import oracle
from lutrin.plans import queries as core


def queries() -> dict:
    return core.QUERIES | ledger.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: q.strip() for k, q in (oracle.ORACLE | ledger.ORACLE).items()}
