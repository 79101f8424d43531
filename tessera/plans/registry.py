"""All registered queries: importing a plans module registers its queries with the catalogue."""

from __future__ import annotations

from tessera.plans import relational, scalars, search, streams, surface  # noqa: F401
from tessera.plans.catalogue import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
