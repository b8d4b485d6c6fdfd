"""All registered queries and their check SQL."""

from __future__ import annotations

from dqspark.plans import catalog_columns, catalog_fill, catalog_rows, catalog_score, catalog_watch

_PARTS = (catalog_rows, catalog_columns, catalog_fill, catalog_score, catalog_watch)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: text for part in _PARTS for name, text in part.ORACLE.items()}
