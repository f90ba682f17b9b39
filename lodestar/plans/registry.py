"""All queries of the reference's operators with their oracles."""

from __future__ import annotations

from lodestar.plans import analytics, files, relational  # noqa: F401  they fill the registry
from lodestar.plans.base import ORACLE, QUERIES, Query

__all__ = ["ORACLE", "QUERIES", "Query"]
