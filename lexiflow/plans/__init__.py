"""Derived views, registered queries and their SQL."""

from . import deck_queries, entry_queries, review_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "deck_queries", "entry_queries", "review_queries", "text_queries"]
