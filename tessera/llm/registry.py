"""All queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

NAMES = ["splitting", "tokens", "neighbours", "mixing", "sentences", "secrets", "pairs", "syntax", "provenance"]


#: Imported with the registry, so that a library that is missing shows as an import error of the subpackage.
MODULES = [importlib.import_module(f"tessera.llm.{name}") for name in NAMES]


def queries() -> dict[str, Callable]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
