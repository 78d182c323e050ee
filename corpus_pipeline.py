"""The corpus pipeline over ``documents``: five operators in a row, each stage written as Parquet and read again."""

from __future__ import annotations

from scoutmill.llm.pipeline import STAGES, run

#: Compression scores, random walks and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
