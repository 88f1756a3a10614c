"""All queries of the engine's own operators."""

from __future__ import annotations

from gridloom.plans import codec_queries, column_queries, dependency_queries, extended_queries, spatial_queries, streaming_queries, surface_queries  # noqa: F401
from gridloom.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
