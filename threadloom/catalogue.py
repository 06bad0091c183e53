"""All queries by name, and their SQL."""

from __future__ import annotations

from threadloom.plans import archive_queries, report_queries, semantic_queries  # noqa: F401  they register themselves
from threadloom.plans.registry import QUERIES, SQL  # noqa: F401
