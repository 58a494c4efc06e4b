"""Queries by name, and their DuckDB twins."""

from . import reads, records, rules, streams, work  # noqa: F401  register their queries
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
