"""All queries of this package over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog, catalog_documents, catalog_extra, catalog_lineage, catalog_models, catalog_more, catalog_rest, catalog_rollups, catalog_rules, catalog_sources, catalog_state  # noqa: F401  (all fill the same tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
