"""All queries of the engine by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .plans import catalog, catalog_align, catalog_code, catalog_data

__all__ = ["catalog_align", "catalog_code", "catalog_data", "oracle_sql", "queries"]


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
