"""All registered queries, with their SQL."""

from __future__ import annotations

from . import detail_queries, function_queries, model_queries, queries, source_queries  # noqa: F401  (modules register their queries when they are imported)

QUERIES, SQL = queries.QUERIES, queries.SQL
