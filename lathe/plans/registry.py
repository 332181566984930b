"""All registered queries with their DuckDB SQL."""

from __future__ import annotations

from lathe.plans import chain_queries, clean_queries, evaluate_queries, feature_queries, guard_queries, join_queries, learn_queries, mart_queries, more_queries, quality_queries, request_queries, stream_queries, whole_mart_queries  # noqa: F401
from lathe.plans.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "chain_links"
