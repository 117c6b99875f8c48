"""Imports every query module, so that the registry is full."""

from lodestrata.plans import files, integrity, layouts, loading, lookups, more, notices, places, records, rent, retrieval, scalars, streams, texts  # noqa: F401
from lodestrata.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
