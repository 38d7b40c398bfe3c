"""The queries over the log and their SQL."""

from __future__ import annotations

from siltlog.plans import log_queries, model_queries, policy_queries, stream_queries  # noqa: F401  (registers its queries)
from siltlog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
