"""All registered queries, by area."""

from basketry.plans import (  # noqa: F401
    catalog_queries,
    event_queries,
    feature_queries,
    index_queries,
    model_queries,
    user_queries,
)
from basketry.plans.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
