"""All queries of the engine."""

from . import serving_queries, text_queries, wide_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
