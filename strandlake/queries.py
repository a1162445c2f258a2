"""Query registry of the engine."""

from __future__ import annotations

from .plans import catalog, check, contamination, groups, models, taxonomy
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "check", "contamination", "flagship", "groups", "models", "taxonomy"]


def flagship(spark, sf_dir):
    """Filtered, live genomes of the catalogue."""
    return QUERIES["tombstone_anti"](spark, sf_dir)
