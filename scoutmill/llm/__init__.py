"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

``QUERIES`` and ``SQL`` hold the registered queries and their DuckDB twins.
"""

from scoutmill.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
