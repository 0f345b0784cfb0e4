"""Registered queries of the engine's own operators."""

from . import audit_queries, io_queries, record_queries, rule_queries, set_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
