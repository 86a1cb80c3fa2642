"""All graph queries by operator id, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .plans.oracles import ORACLE_SQL
from .plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
