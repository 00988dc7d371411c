"""All queries of the road graph, by operator, and the SQL that says the same for DuckDB."""

from __future__ import annotations

from . import q_costing, q_geo, q_graph, q_last, q_lines, q_more, q_route, q_rules, q_scalar, q_stream, q_traffic  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = QUERIES["pth04_cheapest_path"]

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
