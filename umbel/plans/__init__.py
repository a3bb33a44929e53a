"""Queries on the driver tables and the SQL that states the same answer."""

from . import (  # noqa: F401
    derive_queries, join_queries, match_queries, review_queries, source_queries, stream_queries, text_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
