"""All queries of the core and the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from tessera.plans import assessment, capsules, channels, explore, graphs, hierarchies, index, ingest, memory, relational, retrieval, scalars, understanding

MODULES = [hierarchies, relational, retrieval, graphs, memory, capsules, index, understanding, scalars, assessment, channels, ingest, explore]
FLAGSHIP = "capsule"


def queries() -> dict[str, Callable]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
