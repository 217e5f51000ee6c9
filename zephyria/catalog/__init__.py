"""Named queries, one per operator, each with the SQL it is checked against."""

from zephyria.catalog import (  # noqa: F401  (importing a section registers its queries)
    aggregate_queries,
    class_queries,
    column_queries,
    composite_queries,
    join_queries,
    long_series_queries,
    model_queries,
    ordering_queries,
    scalar_queries,
    source_queries,
    stream_queries,
    window_queries,
)
from zephyria.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
