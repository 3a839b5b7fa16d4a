"""All named queries."""

from __future__ import annotations

from backtrail.plans import (
    attribution_queries,
    event_queries,
    model_queries,
    table_queries,
    track_queries,
)
from backtrail.plans.registry import Query


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in (event_queries, track_queries, attribution_queries, model_queries, table_queries):
        twice = out.keys() & module.QUERIES.keys()
        if twice:
            raise ValueError(f"query names used twice: {sorted(twice)}")
        out |= module.QUERIES
    return out
