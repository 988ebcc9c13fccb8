"""All queries of the catalogue, and their counterparts in SQL."""

from tessera.plans import catalog_io  # noqa: F401  declares its queries
from tessera.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
