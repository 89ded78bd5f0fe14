"""Registered queries over the given tables."""

from eventlens.catalog import event_queries, feature_queries, manifest_queries
from eventlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "event_queries", "feature_queries", "manifest_queries"]
