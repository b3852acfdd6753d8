"""All queries of the library but those of its text subpackage."""

from __future__ import annotations

from pixelframe.plans import catalogue_queries, grade_queries, ledger_queries, mask_queries, pixel_queries
from pixelframe.plans.pixel_queries import flagship
from pixelframe.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalogue_queries", "flagship", "grade_queries", "ledger_queries", "mask_queries", "pixel_queries"]
