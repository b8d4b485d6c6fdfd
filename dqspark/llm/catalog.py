"""The registered queries of these operators and their DuckDB texts."""

from __future__ import annotations

from dqspark.llm import queries

QUERIES = queries.QUERIES
ORACLE = queries.ORACLE
