"""Named queries over the driver's tables and the SQL that states each result independently."""

from __future__ import annotations

from quarry.plans import extract_queries, investigation_queries, lead_queries, queue_queries, row_queries, source_queries, stream_queries, text_queries  # noqa: F401  (importing a module registers its queries)
from quarry.plans.registry import Query, query


def queries() -> dict[str, Query]:
    return dict(query.queries)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
