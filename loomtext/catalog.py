"""All queries of the library's own operators and their DuckDB twins."""

from __future__ import annotations

from loomtext.plans import cleaning_queries, document_queries, ledger_queries, measure_queries, planning_queries, relational_queries, source_queries, star_queries, stream_queries  # noqa: F401
from loomtext.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
