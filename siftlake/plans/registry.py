"""All queries of the core and their SQL."""

from __future__ import annotations

from siftlake.plans import audits, suite  # noqa: F401  they register their queries
from siftlake.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
