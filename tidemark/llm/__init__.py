"""Operators for the preparation of language-model training data.

Nothing else in the library imports this subpackage. ``queries`` and ``oracle_sql`` are what
``__spark_entry__`` registers.
"""

from tidemark.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
