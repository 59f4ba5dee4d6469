"""Registered queries, one module per group of operators."""

from serieswise.catalog import (  # noqa: F401
    frame_queries,
    metric_queries,
    model_queries,
    profile_queries,
    selection_queries,
    table_queries,
    window_queries,
)
from serieswise.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
