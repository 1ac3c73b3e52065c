"""Runnable queries over the given tables."""

from evidgrid.queries import (  # noqa: F401
    cluster_queries,
    detail_queries,
    document_queries,
    evidence_queries,
    graph_queries,
    rule_queries,
    run_queries,
    source_queries,
    stream_queries,
    text_queries,
)
from evidgrid.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
