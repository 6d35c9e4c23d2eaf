"""The registered queries: the library's operators over the given tables."""

from __future__ import annotations

from . import aggregates, catalogue, payload_facts, predicates, publishing, rule_queries
from .base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "aggregates", "catalogue", "payload_facts", "predicates",
           "publishing", "rule_queries"]
