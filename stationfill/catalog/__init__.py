"""Registered queries: each runs an operator over the given tables, most with an equivalent in SQL."""

from .registry import queries, sql_texts

__all__ = ["queries", "sql_texts"]
