"""All catalogued queries of the engine, and the SQL for each that SQL can state."""

from __future__ import annotations

from tesserae.plans import extra_queries, field_queries, file_queries, function_queries, further_queries, grid_queries, mesh_queries, other_queries, primitive_queries, volume_queries
from tesserae.plans.registry import Query

PARTS = (primitive_queries.R, field_queries.R, mesh_queries.R, other_queries.R, further_queries.R, volume_queries.R, grid_queries.R, function_queries.R, extra_queries.R, file_queries.R)


def queries() -> dict[str, Query]:
    return {name: plan for part in PARTS for name, plan in part.plans.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.sql.items()}
