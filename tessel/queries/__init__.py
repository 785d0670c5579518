"""Registered queries; importing this package fills QUERIES and SQL."""

from tessel.queries.registry import QUERIES, SQL  # noqa: I001
from tessel.queries import dense, lexical, ranking, social  # noqa: F401

__all__ = ["QUERIES", "SQL"]
